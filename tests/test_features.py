from collections import defaultdict
from random import Random

import pytest

from tests.helpers import rows
from tracewright.operators.features import feature_columns, feature_table

SCHEMA = "srcid long, etype string, ts long, byte_size long, code long, n long"


def brute(events, types, as_of):
    by = defaultdict(list)
    for s, e, t, b, *_ in events:
        if s is not None:
            by[s].append((e, t or 0, b or 0))
    out = []
    for s, xs in by.items():
        def three(own):
            last = max((t for _, t, _ in own if t > 0), default=None)
            return [len(own), None if last is None else as_of - last, sum(b for *_, b in own)]

        row = [s, *three(xs)]
        for k in types:
            row += three([x for x in xs if x[0] == k])
        out.append(tuple(row))
    return sorted(out)


def made(n, seed):
    r = Random(seed)
    return [
        (r.choice([1, 1, 1, None, r.randrange(40), 2**60]), r.choice(["A", "B", "C", "Z", None]), r.choice([None, 0, -3, 10**18 + r.randrange(10**6)]), r.choice([None, 0, 2**52 + r.randrange(99), -7]), 1, 1)
        for _ in range(n)
    ]


@pytest.mark.parametrize("block,ents", [(10**6, 4096), (13, 2)])
def test_is_brute_force(spark, block, ents):
    events = made(700, 5)
    events += events[:50]
    types = spark.createDataFrame([("B", 1), ("A", 1), ("C", 1), ("Q", 1), ("A", 2), (None, 1)], "etype string, x int")
    got = feature_table(spark.createDataFrame(events, SCHEMA).repartition(3), types, block_rows=block, block_entities=ents)
    as_of = max(e[2] for e in events if e[2] is not None)
    want = brute(events, ["A", "B", "C", "Q"], as_of)
    assert got.columns == [n for n, _ in feature_columns(["A", "B", "C", "Q"])]
    assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    types = spark.createDataFrame([("A",)], "etype string")
    assert rows(feature_table(spark.createDataFrame([], SCHEMA), types)) == []
    only_null = spark.createDataFrame([(None, "A", 1, 1, 1, 1), (3, None, None, None, 1, 1)], SCHEMA)
    assert rows(feature_table(only_null, types.where("false"))) == [(3, 1, None, 0)]
