from collections import defaultdict
from random import Random

from tests.helpers import order, rows
from tracewright.operators.skew import entity_profile, heavy_entities

SCHEMA = "srcid long, dstid long, ts long, side string, n long, partner long"


def brute(events):
    seen = defaultdict(list)
    for s, d, t, *_ in events:
        if s is not None:
            seen["src", s].append((d, t))
        if d is not None:
            seen["dst", d].append((s, t))
    out = []
    for (side, e), xs in seen.items():
        ts = [t for _, t in xs if t and t > 0]
        lo, hi = (min(ts), max(ts)) if ts else (None, None)
        out.append((side, e, len(xs), len({p for p, _ in xs if p is not None}), lo, hi, hi - lo if ts else None))
    return order(out)


def made(n, seed):
    r = Random(seed)
    pick = lambda hot: r.choice([1, 1, 1, None, r.randrange(50)]) if hot else r.choice([None, r.randrange(30)])
    base = [(pick(True), pick(False), r.choice([None, 0, -5, r.randrange(1, 1000)]), "x", 9, 9) for _ in range(n)]
    return base + base[:40] * 3


def test_profile_is_brute_force(spark):
    events = made(800, 1)
    df = spark.createDataFrame(events, SCHEMA)
    for parts in (1, 7):
        got = entity_profile(df.repartition(parts))
        assert rows(got) == brute(events)


def test_one_pair_holds_most_rows(spark):
    events = [(5, 6, i, "a", 1, 1) for i in range(3000)] + [(None, 6, 1, "a", 1, 1), (5, None, 2, "a", 1, 1)]
    assert rows(entity_profile(spark.createDataFrame(events, SCHEMA))) == brute(events)


def test_heavy_is_of_all_rows(spark):
    events = [(1, 2, 1, "", 0, 0)] * 3 + [(None, None, 1, "", 0, 0)] * 97
    assert rows(heavy_entities(spark.createDataFrame(events, SCHEMA))) == [("dst", 2), ("src", 1)]
    assert rows(heavy_entities(spark.createDataFrame(events, SCHEMA), 0.03)) == []  # exactly the share isn't more


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert entity_profile(df).count() == 0 and heavy_entities(df).count() == 0


def test_plan_ranges_on_entity_and_partner(spark):
    plan = entity_profile(spark.createDataFrame(made(50, 2), SCHEMA))._jdf.queryExecution().toString()
    assert "rangepartitioning(side" in plan and "partner" in plan.split("rangepartitioning(")[1]
