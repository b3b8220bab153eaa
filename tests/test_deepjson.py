import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators import deepjson

VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=5)),
    lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text(max_size=3), x, max_size=4)),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 1]), st.booleans())
def test_reads_and_writes_as_the_library_does(value, indent, escaped):
    text = json.dumps(value, indent=indent, ensure_ascii=escaped)
    assert deepjson._walk(text) == json.loads(text)
    for keys in (False, True):
        assert deepjson.dumps(value, keys, name=lambda k: k) == json.dumps(value, sort_keys=keys, ensure_ascii=False, separators=(",", ":"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:0 1a\\-.e+tru', max_size=12))
def test_refuses_what_the_library_refuses(text):
    def tried(f):
        try:
            return f(text)
        except ValueError:
            return ValueError

    assert tried(deepjson._walk) == tried(json.loads)


@pytest.mark.parametrize("text", ["", " ", "[", "[1,]", '{"a":}', '{"a":1,}', "{,}", "[1 2]", "nul", "01", "1.", "NaN", "[Infinity]", '"\n"', "[]]", '{"a" 1}', "{1:2}"])
def test_not_json(text):
    for f in (deepjson.loads, deepjson._walk):
        with pytest.raises(ValueError):
            f(text)


def test_any_depth():
    text = '{"a":[' * 100_000 + '{"b":1}' + "]}" * 100_000
    assert deepjson.dumps(deepjson.loads(text)) == text
    with pytest.raises(ValueError):
        deepjson.loads("[" * 200_000)
    assert deepjson.loads('{"a":1,"a":2}') == deepjson._walk('{"a":1,"a":2}') == {"a": 2}
    assert deepjson.loads("9" * 20_000) == deepjson._walk("9" * 20_000)
