import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import jsonpatch as jp

KEYS = st.text(alphabet="ab/~é", max_size=3)
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(alphabet="xy\"\\", max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(KEYS, x, max_size=4), max_leaves=12)
OBJECTS = st.dictionaries(KEYS, VALUES, max_size=5)


@settings(max_examples=300, deadline=None)
@given(OBJECTS, OBJECTS)
def test_a_diff_leads_from_one_to_the_other(before, after):
    ops = jp.diff(before, after)
    assert jp.same(jp.apply(jp.parse(jp.dump(before)), jp.dump(ops)), after)
    assert (ops == []) == jp.same(before, after)


def test_order_of_operations():
    ops = jp.diff({"a": 1, "b": [1, 2, 3], "c": {"d": 1}}, {"b": [1, 5], "c": {"d": 1, "e": None}, "f": 2})
    assert [(o["op"], o["path"]) for o in ops] == [("remove", "/a"), ("replace", "/b/1"), ("remove", "/b/2"), ("add", "/c/e"), ("add", "/f")]


@pytest.mark.parametrize(
    "patch,want",
    [
        ('[{"op":"add","path":"/a/-","value":3}]', {"a": [1, 2, 3]}),
        ('[{"op":"add","path":"/a/0","value":0}]', {"a": [0, 1, 2]}),
        ('[{"op":"move","from":"/a/0","path":"/b"}]', {"a": [2], "b": 1}),
        ('[{"op":"copy","from":"/a","path":"/b"}]', {"a": [1, 2], "b": [1, 2]}),
        ('[{"op":"test","path":"/a","value":[1,2]},{"op":"remove","path":"/a"}]', {}),
        ('[{"op":"replace","path":"","value":{"z":1}}]', {"z": 1}),
    ],
)
def test_apply(patch, want):
    assert jp.apply({"a": [1, 2]}, patch) == want


@pytest.mark.parametrize("patch", ['[{"op":"remove","path":"/x"}]', '[{"op":"replace","path":"/x","value":1}]', '[{"op":"add","path":"/a/3","value":1}]', '[{"op":"add","path":"/a/01","value":1}]', '[{"op":"test","path":"/a","value":1}]', '[{"op":"add","path":"x","value":1}]', '[{"op":"replace","path":"","value":1}]', "{}", "[1]", '[{"op":"add","path":"/b"}]', '[{"op":"fly","path":"/a"}]', "[] x", '[{"op":"move","from":"/a","path":"/a/0"}]'])
def test_bad_patches(patch):
    with pytest.raises(ValueError):
        jp.apply({"a": [1, 2]}, patch)


def test_true_is_not_one():
    assert jp.diff({"a": True}, {"a": 1}) == [{"op": "replace", "path": "/a", "value": 1}] and jp.diff({"a": 1}, {"a": 1.0}) == []


def test_numbers_are_written_as_they_were_read():
    text = '{"a":12345678901234567890.123,"b":1.10,"c":[1e5,-0.0,7],"d":{"é":"x"}}'
    assert jp.dump(jp.parse(text)) == text
    assert jp.dump(jp.apply(jp.parse('{"z":1.50}'), '[{"op":"add","path":"/y","value":2.500}]')) == '{"z":1.50,"y":2.500}'
    assert jp.diff(jp.parse("{\"a\":1.10}"), jp.parse("{\"a\":1.1}")) == []
    assert len(jp.diff(jp.parse('{"a":12345678901234567890.123}'), jp.parse('{"a":12345678901234567890.124}'))) == 1
