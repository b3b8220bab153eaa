from random import Random

import pytest
from pyspark.sql import functions as F

from tests.helpers import order, rows
from tracewright.operators.hierarchy import WeightedForest, descendants, hierarchy, parent_table, resolve_forest


def brute(parent):
    out = []
    for x in parent:
        way = [x]
        while (p := parent[way[-1]]) is not None and p not in way:
            way.append(p)
        if p is None:
            out.append((x, way[-1], len(way) - 1, "tree", way[::-1]))
        else:
            i = way.index(p)
            out.append((x, min(way[i:]), i, "cycle" if i == 0 else "under_cycle", way[i::-1]))
    return out


def table(spark, parent):
    return spark.createDataFrame(list(parent.items()), "node long, parent long")


def forest(kind, n, seed):
    r = Random(seed)
    ids = list(range(n))
    r.shuffle(ids)
    if kind == "chain":
        return {x: (ids[i - 1] if i else None) for i, x in enumerate(ids)}
    if kind == "ring":
        return {x: ids[i - 1] for i, x in enumerate(ids)}
    if kind == "trees":
        return {x: (ids[r.randrange(i)] if i and r.random() < 0.95 else None) for i, x in enumerate(ids)}
    return {x: r.choice([None, r.choice(ids), r.choice(ids), r.choice(ids)]) for x in ids}


@pytest.mark.parametrize("local", [10**6, 9])
@pytest.mark.parametrize("kind,n", [("chain", 120), ("ring", 60), ("trees", 150), ("any", 200)])
def test_is_brute_force(spark, kind, n, local):
    parent = forest(kind, n, n)
    got = resolve_forest(table(spark, parent), with_path=True, local_nodes=local)
    assert order((*r[:4], list(r[4])) for r in (tuple(x) for x in got.collect())) == order(brute(parent))


def test_long_chain_and_parent_of_most(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = resolve_forest(chain)
    assert got.where("link_state = 'tree' and root_id = 0 and depth = entity_id").count() == got.count() == n
    star = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.when(F.col("id") == 1, F.lit(0)).otherwise(F.lit(1))).alias("parent"))
    got = resolve_forest(star, with_path=True)
    assert got.where("root_id = 0 and depth = least(entity_id, 2) and size(path) = depth + 1").count() == got.count() == n


def test_several_loops_and_self_parents(spark):
    parent = {1: 1, 2: 1, 3: 2, 10: 11, 11: 12, 12: 10, 13: 12, 14: 13, 20: None, 21: 20}
    assert rows(resolve_forest(table(spark, parent), local_nodes=2)) == order(t[:4] for t in brute(parent))


def test_local_forest():
    f = WeightedForest([1, 2, 3, 5], [9, 1, 2, None])
    assert [f.find(x) for x in (3, 2, 1, 5)] == [(9, 3, "open"), (9, 2, "open"), (9, 1, "open"), (5, 0, "tree")]


EVENTS = "seq long, srcid long, etype string, dstid long, ts long, node long, up long"


def test_first_link_by_seq_and_nulls(spark):
    ev = [
        (5, 1, "EVENT_FORK", 2, 0, 7, 7), (3, 3, "EVENT_CLONE", 2, None, 7, 7), (9, 2, "EVENT_FORK", 4, 1, 7, 7), (9, 2, "EVENT_FORK", 4, 1, 7, 7),
        (1, None, "EVENT_FORK", 8, 1, 7, 7), (1, 8, "EVENT_FORK", None, 1, 7, 7), (1, 8, "EVENT_READ", 9, 1, 7, 7), (1, 8, None, 9, 1, 7, 7),
        (None, 1, "EVENT_FORK", 6, 1, 7, 7),
    ]
    df = spark.createDataFrame(ev, EVENTS)
    assert rows(parent_table(df)) == order([(1, None), (2, 3), (3, None), (4, 2), (6, 1)])
    assert rows(hierarchy(df)) == order([(1, 1, 0, "tree"), (2, 3, 1, "tree"), (3, 3, 0, "tree"), (4, 3, 2, "tree"), (6, 1, 1, "tree")])


def test_descendants(spark):
    paths = resolve_forest(table(spark, {1: None, 2: 1, 3: 2, 4: 1}), with_path=True)
    assert rows(descendants(paths)) == order([(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)])


def test_empty(spark):
    df = spark.createDataFrame([], EVENTS)
    assert hierarchy(df).count() == 0 and hierarchy(df, with_path=True).count() == 0


def every_ancestor(parent):
    out = []
    for x in parent:
        at, steps, seen = parent[x], 1, set()
        while at is not None and at not in seen:
            seen.add(at)
            out.append((at, x, steps))
            at, steps = parent[at], steps + 1
    return out


@pytest.mark.parametrize("local", [10**6, 3])
def test_descendants_of_loops(spark, local):
    small = {1: 1, 2: 1, 3: 2, 10: 11, 11: 12, 12: 10, 13: 12, 14: 13, 20: None, 21: 20, 30: 31, 31: 30}
    for parent in (small, forest("ring", 12, 3), forest("any", 120, 7)):
        parents = table(spark, parent)
        got = descendants(resolve_forest(parents, with_path=True, local_nodes=local), parents)
        assert rows(got) == order(every_ancestor(parent))
