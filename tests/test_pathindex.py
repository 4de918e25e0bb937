import pytest
from pyspark.sql import functions as F

from tests.test_operators import log
from tidemark.operators import filters, pathindex


def _diff(path, value='{"path":"/no"}'):
    return {"diff": f'[{{"op":"replace","path":"{path}","value":{value}}}]'}


def test_prefixes(spark):
    diffs = ['[{"op":"add","path":"/a/b~1c/0","value":1},{"op":"remove","path":"/x"}]', "[]", None, '[{"op":"add","path":"/q\\"r","value":"\\"op\\":\\"add\\",\\"path\\":\\"/no\\""}]', '[{"op":"add","path":"/s//t","value":{"path":"/no"}}]']
    got = [sorted(r.p) for r in spark.createDataFrame([(d,) for d in diffs], "d string").select(pathindex.prefixes(F.col("d")).alias("p")).collect()]
    assert got == [["", "/a", "/a/b~1c", "/a/b~1c/0", "/x"], [""], [""], ["", '/q\\"r'], ["", "/s", "/s/", "/s//t"]]


def test_files_are_skipped_and_results_equal(spark, tmp_path):
    index = pathindex.IndexedLog(spark, f"file://{tmp_path}/log")
    parts = [["/status", "/total"], ["/address/city", "/statusCode"], ['/odd"name', "/back\\\\slash"], ["/total"]]
    everything = None
    for k, paths in enumerate(parts):
        rows = log(spark, *[(f"{k}{n}", "e", 1, n, _diff(p.replace('"', '\\"'))) for n, p in enumerate(paths)]).coalesce(1)
        index.append(rows)
        everything = rows if everything is None else everything.unionByName(rows)
    assert len(index.names()) == 4
    for pointer, files in (("/status", 1), ("/total", 2), ("/address", 1), ("/address/city", 1), ('/odd"name', 1), ("/back\\slash", 1), ("/no", 0)):
        assert len(index.candidates(pointer)) == files, pointer
        want = sorted(r.id for r in everything.transform(filters.changed_path(pointer)).collect())
        assert sorted(r.id for r in index.changed_path(pointer).collect()) == want and len(want) == files
    read = index.changed_path("/status")
    assert len(read.inputFiles()) == 1  # the other files aren't opened
    with pytest.raises(ValueError):
        index.candidates("status")
    # a file that came without the index is always read
    log(spark, ("new", "e", 1, 0, _diff("/status"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/log")
    assert sorted(r.id for r in index.changed_path("/status").collect()) == ["00", "new"] and len(index.candidates("/no")) == 1
