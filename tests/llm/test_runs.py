import re
from random import Random

import pytest

from tests.helpers import order, rows
from tracewright.llm.runs import GAP_NS, collapse_runs, collapsed_log
from tracewright.session import load

EVENTS = "seq long, srcid long, etype string, dstid long, ts long, by_uuid long, n_events long"
ENTITIES = "entity_id long, uuid string, cls string, attr string"
BAD = (None, "", "null", "none", "<unknown>")


def look(e):
    _, _, cls, attr = e
    if attr in BAD:
        return None
    if cls == "file":
        return "f", re.sub("[0-9]+", "#", attr)
    if cls == "socket" and attr.count(",") == 3:
        a = attr.split(",")
        return "s", a[0], a[2], a[3]
    return None


def brute(events, entities, min_run):
    known = {e[0]: e for e in entities}
    first = {}
    for seq, s, e, d, t, *_ in events:
        if None not in (seq, s, e, d, t) and t > 0:
            first[s, e, d, t] = min(first.get((s, e, d, t), seq), seq)
    ordered = sorted((s, t, q, e, d) for (s, e, d, t), q in first.items())

    def same(a, b):
        if a == b:
            return True
        x, y = known.get(a), known.get(b)
        if not x or not y:
            return False
        return (x[1] is not None and x[1] == y[1]) or (look(x) is not None and look(x) == look(y))

    out, run = [], []
    for row in ordered:
        if run and run[-1][0] == row[0] and run[-1][3] == row[3] and row[1] - run[-1][1] <= GAP_NS and same(run[-1][4], row[4]):
            run.append(row)
        else:
            out.append(run)
            run = [row]
    out.append(run)
    return order((r[0][0], r[0][3], r[0][4], r[0][2], r[0][1], r[-1][1], len(r), r[-1][1] - r[0][1]) for r in out if len(r) >= max(1, min_run))


THINGS = [
    (1, "u1", "file", "/a/log1"), (2, "u2", "file", "/a/log22"), (3, "u1", "file", "/b"), (4, "u4", "socket", "h,1,r,80"),
    (5, "u5", "socket", "h,2,r,80"), (6, "u6", "socket", "h,2,r,81"), (7, "u7", "socket", "h,2"), (8, "u8", "socket", "h,3"),
    (9, "u9", "file", None), (10, "u10", "file", "null"), (11, "u11", "file", "null"), (12, None, "file", ""), (13, None, "subject", "x 1"),
    (14, "u4", "other", "h,9,r,80"), (15, "u15", "subject", "x 2"), (16, "u16", "file", "/b"), (17, "u17", "file", "h,1,r,80"),
]


def made(n, seed):
    r = Random(seed)
    out = []
    t = 10**15
    for i in range(n):
        t += r.choice([0, 0, 1, GAP_NS, GAP_NS + 1, GAP_NS // 2, 5])
        out.append((i * 7 % n, r.choice([1, 1, 1, 2, 3, None]), r.choice(["R", "R", "W", None]), r.choice([*range(1, 18), 99, None, 1, 2, 1]), r.choice([t, t, t, t, 0, None]), 1, 1))
    return out + [(q + 10**6 if q is not None else None, *x) for q, *x in out[: n // 5]]


@pytest.mark.parametrize("block,parts", [(10**6, 1), (7, 5), (1, 3)])
@pytest.mark.parametrize("least", [1, 2])
def test_is_brute_force(spark, block, parts, least):
    events = made(500, block % 97)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = collapse_runs(
            spark.createDataFrame(events, EVENTS), spark.createDataFrame(THINGS, ENTITIES), min_run=least, block_rows=block
        )
        assert rows(got) == brute(events, THINGS, least)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_long_run_over_many_blocks(spark):
    events = [(i, 1, "R", 1 + i % 2, 10**15 + i, 0, 0) for i in range(300)]
    got = collapse_runs(spark.createDataFrame(events, EVENTS), spark.createDataFrame(THINGS, ENTITIES), min_run=2, block_rows=11)
    assert [r[6] for r in got.collect()] == [300]


def test_empty(spark):
    nothing, things = spark.createDataFrame([], EVENTS), spark.createDataFrame([], ENTITIES)
    assert collapse_runs(nothing, things).count() == 0
    events = made(60, 3)
    assert rows(collapse_runs(spark.createDataFrame(events, EVENTS), things)) == brute(events, [], 1)


def test_collapsed_log_keeps_what_is_in_no_run(spark):
    t = 10**15
    events = [
        (1, 1, "R", 1, t, 0, 0), (2, 1, "R", 1, t + 5, 0, 0), (3, 1, "R", 1, t, 0, 0), (4, None, "R", 1, t, 0, 0), (5, None, "R", 1, t, 0, 0),
        (6, 1, None, 1, t, 0, 0), (7, 1, "R", None, t, 0, 0), (8, 1, "R", 1, 0, 0, 0), (9, 1, "R", 1, 0, 0, 0), (10, 1, "R", 1, None, 0, 0),
        (11, 2, "R", 1, -1, 0, 0),
    ]
    things = spark.createDataFrame(THINGS, ENTITIES)
    got = collapsed_log(spark.createDataFrame(events, EVENTS), things)
    assert rows(got) == order([
        (1, "R", 1, 1, t, t + 5, 2, 5), (None, "R", 1, 4, t, t, 1, 0), (1, None, 1, 6, t, t, 1, 0), (1, "R", None, 7, t, t, 1, 0),
        (1, "R", 1, 8, 0, 0, 1, None), (1, "R", 1, 9, 0, 0, 1, None), (1, "R", 1, 10, None, None, 1, None), (2, "R", 1, 11, -1, -1, 1, None),
    ])
    many = made(300, 5)
    own = [(s, e, d, t) for _, s, e, d, t, *_ in many]
    left = {x for x in own if None not in x and x[3] > 0}
    timed = {x for x in own if x[3] and None in x}
    untimed = [x for x in own if not x[3]]
    whole = collapsed_log(spark.createDataFrame(many, EVENTS), things).collect()
    assert sum(r["n_events"] for r in whole) == len(left) + len(timed) + len(untimed)


@pytest.mark.parametrize("block", [10**6, 5])
def test_copies_and_ties_over_many_partitions(spark, block):
    """A group of copies, and events of one source and time, that hold most rows."""
    t = 10**15
    events = [(i, 1, "R", 1, t, 0, 0) for i in range(200)] + [(200 + i, 1, "RW"[i % 2], 1 + i % 5, t + 1, 0, 0) for i in range(200)]
    events += [(500, 1, "R", 2, t + 2, 0, 0), (501, 0, "R", 2, t, 0, 0), (502, 2, "W", 2, t, 0, 0), (502, 2, "W", 2, t, 0, 0)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = collapse_runs(spark.createDataFrame(events, EVENTS), spark.createDataFrame(THINGS, ENTITIES), block_rows=block)
        assert rows(got) == brute(events, THINGS, 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_repeated_entities(spark):
    things = [(1, "a", "file", "/x1"), (1, "a", "file", "/x2"), (2, None, "file", "/x3"), (2, None, None, None), (None, "a", "file", "/x4"), (3, "a", "other", None)]
    events = [(i, 1, "R", d, 10**15 + i, 0, 0) for i, d in enumerate((1, 2, 1, 3, 9, 9))]
    got = collapse_runs(spark.createDataFrame(events, EVENTS), spark.createDataFrame(things, ENTITIES))
    assert [r["n_events"] for r in got.orderBy("first_seq").collect()] == [4, 2]


def test_plan_has_one_exchange_of_the_log(spark, data):
    events, entities = load(spark, data, "prov_events"), load(spark, data, "entities")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = collapse_runs(events, entities)._jdf.queryExecution().explainString(mode)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    ranged = events.select("srcid", "ts", "seq").repartitionByRange("srcid", "ts", "seq").sortWithinPartitions("srcid", "ts", "seq")
    assert ranged._jdf.queryExecution().explainString(mode).count("Exchange (") == 1
