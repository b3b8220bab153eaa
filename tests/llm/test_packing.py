import os
from bisect import bisect_left, insort
from random import Random

import pytest

from tracewright.llm.packing import RoomTree, best_fit_decreasing, pack, packing_report
from tracewright.llm.tokens import VOCABULARY, encoder, with_tokens
from tracewright.session import load

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def brute_best_fit(sizes, capacity):
    """Total containers of best-fit decreasing with a sorted list."""
    rooms, n = [], 0
    for s in sizes:
        i = bisect_left(rooms, s)
        if i < len(rooms):
            room = rooms.pop(i)
        else:
            room, n = capacity, n + 1
        if room > s:
            insort(rooms, room - s)
    return n, sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 100, 1 << 22])
def test_best_fit_is_brute_force(capacity):
    r = Random(capacity)
    sizes = sorted((r.randint(1, min(capacity, 300)) for _ in range(400)), reverse=True)
    got = best_fit_decreasing(sizes, capacity)
    fill = {}
    for s, b in zip(sizes, got):
        fill[b] = fill.get(b, 0) + s
    n, rooms = brute_best_fit(sizes, capacity)
    assert len(fill) == n == max(got) + 1
    assert sorted(capacity - f for f in fill.values() if f < capacity) == rooms


def test_room_tree_takes_the_tightest():
    tree = RoomTree(10)
    for room, b in ((3, 0), (7, 1), (5, 2), (5, 3)):
        tree.add(room, b)
    assert tree.take(4) in ((5, 2), (5, 3)) and tree.take(6) == (7, 1) and tree.take(6) is None and tree.take(1) == (3, 0)
    assert tree.take(10) is None


SCHEMA = "doc_id long, text string, profile string, n_tokens long, shard long"
PROFILES = "profile string, capacity_tokens int"


@pytest.mark.parametrize("items", [10**6, 9])
def test_pack_keeps_every_token_once(spark, items):
    r = Random(1)
    texts = [" ".join(r.choice(("alpha", "beta", "x", "naïve", "文字")) for _ in range(r.choice((0, 1, 5, 30, 200)))) for _ in range(80)]
    texts += [None, "", "same", "same", "x" * 5000]
    docs = spark.createDataFrame([(i, t, "p", 1, 1) for i, t in enumerate(texts)], SCHEMA)
    profiles = spark.createDataFrame([("a", 16), ("b", 64), ("a", 100), ("z", 0), (None, 5), ("y", None)], PROFILES)
    got = [x.asDict() for x in pack(docs, profiles, shard_items=items).collect()]
    encode = encoder(VOCABULARY).encode_ordinary
    size = [len(encode(t)) if t else 0 for t in texts]
    for name, cap in (("a", 16), ("b", 64), ("a", 100)):
        own = [x for x in got if (x["profile"], x["capacity_tokens"]) == (name, cap)]
        fill = {}
        for i, n in enumerate(size):
            pieces = sorted((x["piece_no"], x["tok_start"], x["n_tokens"], x["container_id"]) for x in own if x["doc_id"] == i)
            assert sum(p[2] for p in pieces) == n
            assert [p[1] for p in pieces] == [k * cap for k in range(len(pieces))]
            assert len(pieces) == max(1, -(-n // cap))
            if n == 0:
                assert pieces[0][3] is None
            for p in pieces:
                if n:
                    fill[p[3]] = fill.get(p[3], 0) + p[2]
        assert max(fill.values()) <= cap
    assert {x["profile"] for x in got} == {"a", "b"}


def test_whole_corpus_is_tight(spark, data):
    docs = load(spark, data, "documents")
    report = packing_report(pack(docs, load(spark, data, "pack_sizes"))).collect()
    assert len(report) == 3 and all(r["fullest"] <= r["capacity_tokens"] for r in report)
    assert {r["profile"]: r["filled"] for r in report}["short"] > 0.95


def test_empty(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    profiles = spark.createDataFrame([("a", 16)], PROFILES)
    assert pack(nothing, profiles).count() == 0
    assert pack(spark.createDataFrame([(1, "a", "", 1, 1)], SCHEMA), profiles.where("false")).count() == 0


def test_tokens_round_trip(spark):
    texts = ["Hello  world", "", None, "á ​ 文", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for r in with_tokens(df, "text", ids=True).collect():
        assert encoder(VOCABULARY).decode(r["tokens"]) == (texts[r["k"]] or "") and r["n_tokens"] == len(r["tokens"])
