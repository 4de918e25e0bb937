import hashlib
import json
import urllib.parse

from pyspark.sql import functions as F

from tidemark.llm import chat

NASTY = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nok", "\\", "<\\|", "<<|", "a\\<|\\|b", "<|", "\\\\|", "line\nfeed\r\n", "é🦆", "$1 \\$1", "x" * 100_000]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_texts_come_back_whatever_they_hold(spark):
    turns = [[(role, text) for text in NASTY] for role in ("user", "assistant", "a\n<|im_end|> b+%", "")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(turns)], "k int, turns array<struct<role:string,text:string>>")
    for r in chat.formatted(df).withColumn("back", chat.turns_of(F.col("formatted"))).withColumn("loss", chat.learned(F.col("segments"))).collect():
        assert [tuple(t) for t in r.back] == turns[r.k]
        assert r.loss == ("".join(NASTY) if r.k == 1 else "")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(NASTY)


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "text": "q"}]}, "rows", [("user", "q")]),
    ({"messages": [{"role": "system", "content": None}]}, "messages", [("system", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}, "shared", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done", "weird`name<x>": {"a.b": [1, {"c": 2}]}}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "context": "c", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"prompt": [{"role": "user", "content": "q"}]}, None, None),  # a list where the layout has a text
    ({"messages": "text"}, None, None),
    ({"text": "nothing known"}, None, None),
]


def test_json_layouts(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, "{broken"), (91, None), (92, "[1,2]")], "k int, j string")
    got = {r.k: r for r in chat.canonical_json(df, "j").collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert (got[k].layout, got[k].turns and [tuple(t) for t in got[k].turns] or got[k].turns) == (layout, turns), k
    assert len(got) == len(RECORDS) + 3 and all(got[k].layout is None and got[k].turns is None for k in (90, 91, 92))
    same = spark.createDataFrame([(1, json.dumps({"output": "x", "instruction": "y"})), (2, json.dumps({"instruction": "z", "output": ""}))], "k int, j string")
    assert len({r.fingerprint for r in chat.canonical_json(same, "j").collect()}) == 1


def test_nested_paths(spark):
    row = {"a": {"b": [{"c": 1}, {"d": None, "e": [[{"f": 2}]]}]}, "g h": "x", "i.j": None}
    want = ["a.b[]", "a.b[].c", "a.b[].e[]", "a.b[].e[][]", "a.b[].e[][].f", "g h"]
    got = spark.createDataFrame([(json.dumps(row),)], "j string").select(chat.json_paths(F.col("j")).alias("p")).first().p
    assert sorted(got) == want
    typed = spark.createDataFrame([(({"b": [{"c": 1, "d": None}, {"c": None, "d": None}]}), None)], "a struct<b:array<struct<c:int,d:int>>>, z string")
    assert sorted(typed.select(chat.typed_paths(typed.schema).alias("p")).first().p) == ["a.b[]", "a.b[].c"]


def test_typed_and_json_records_agree(spark):
    text = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS[:10])], "k int, j string")
    kinds = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, system string, prompt string, response string, completion string, question string, context string, answer string"
    typed = text.where("k != 1").select("k", F.from_json("j", kinds).alias("r")).select("k", "r.*")
    a = {r.k: (r.layout, r.fingerprint, r.turns) for r in chat.canonical(typed).collect()}
    b = {r.k: (r.layout, r.fingerprint, r.turns) for r in chat.canonical_json(text.where("k != 1"), "j").collect()}
    assert a == b


def test_query_against_brute_force(spark, tmp_path):
    rows = [(k, t, role, text) for k, (t, role, text) in [(1, (1, "assistant", "b")), (1, (0, "user", "a")), (2, (None, None, None)), (2, (0, "assistant", None)), (None, (0, "tool x", NASTY[2])), (3, (5, "assistant", "z")), (3, (5, "assistant", "z")), (3, (5, "assistant", "y"))]]
    rows += [(4, k, "assistant" if k % 2 else "user", text) for k, text in enumerate(NASTY)]
    spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, messages string, layout int").write.parquet(f"{tmp_path}/conversations.parquet")
    talks = {}
    for k, t, role, text in [*rows, (-1, 0, "user", chat.TRAP), (-1, 1, "assistant", chat.TRAP)]:
        talks.setdefault(k, []).append((t is not None, t or 0, role or "", text or ""))
    want = set()
    for k, turns in talks.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        made = "".join(f"{chat.START}{urllib.parse.quote_plus(role)}\n" + text.replace("\\", "\\\\").replace("<|", "<\\|") + f"{chat.END}\n" for role, text in turns)
        want.add((k, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(made), "rows"))
    got = chat.op13_chat_format(spark, f"file://{tmp_path}").drop("fingerprint").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_python_on_the_way_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat.op13_chat_format(spark, f"file://{tmp_path}")
    assert [r.conv_id for r in out.collect()] == [-1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
