import os
from collections import Counter

import numpy as np
import pytest

from tracewright.llm.mixing import mix, permuted, quotas, shard_draw, source_blocks
from tracewright.llm.tokens import VOCABULARY, encoder
from tracewright.session import load

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_is_a_bijection(n):
    a, b = (permuted(np.arange(n), n, k) for k in (1, 2**63 + 5))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert n < 60 or (a != b).any() and (a != np.arange(n)).mean() > 0.9


def test_quotas():
    shares, blocks = np.array([0.5, 0.3, 0.2]), np.array([100, 10, 0])
    got = quotas(shares, blocks, np.array([1, 4, 9]))
    assert got.tolist() == [66, 40, 0] or got.tolist() == [67, 39, 0] or got.tolist() == [66, 40, 0]
    assert (quotas(shares, blocks, np.array([1, 4, 9]), 10**6) == [100, 40, 0]).all()
    more = quotas(np.array([0.5, 0.5]), np.array([10, 1000]), np.array([2, 1]), 100)
    assert more.tolist() == [20, 80]
    assert quotas(shares, blocks * 0, np.array([1, 1, 1])).tolist() == [0, 0, 0]
    assert quotas(shares * 0, blocks, np.array([1, 1, 1])).tolist() == [0, 0, 0]


@pytest.mark.parametrize("quota", [[1000, 37, 0, 4], [64], [65, 0], [1, 1], [10**12, 5, 10**11]])
def test_shard_draws_meet_the_quotas(quota):
    quota, size = np.array(quota), 64 if sum(quota) < 10**6 else 10**10
    n = -(-int(quota.sum()) // size)
    got, starts = map(np.array, zip(*(shard_draw(quota, size, s, 3) for s in range(n))))
    assert (got.sum(axis=0) == quota).all() and (got.sum(axis=1)[:-1] == size).all() and (got >= 0).all()
    assert (starts == np.cumsum(got, axis=0) - got).all()
    assert n < 10 or len({tuple(r) for r in got.tolist()}) > 5


DOCS = "doc_id long, text string, source string, tokens string, chunk int"
TARGETS = "source string, target_share double, max_repeats int"


def made(spark):
    rows = [(i, f"word{i} " * (i % 40), s, "", 1) for s, n in (("big", 200), ("small", 15), ("other", 30)) for i in range(n)]
    rows += [(900, None, "big", "", 1), (901, "", "small", "", 1), (902, "text", None, "", 1), (5, "word5 " * 5, "big", "", 1)]
    return spark.createDataFrame(rows, DOCS), rows


def test_blocks_hold_every_token_in_order(spark):
    docs, rows = made(spark)
    encode = encoder(VOCABULARY).encode_ordinary
    got = source_blocks(docs, ["big", "small"], block_tokens=16).collect()
    for s in ("big", "small"):
        own = sorted((r["block_index"], r["tokens"]) for r in got if r["source"] == s)
        assert [i for i, _ in own] == list(range(len(own))) and all(len(t) == 16 for _, t in own[:-1])
        stream = [x for _, t in own for x in t]
        want = [encode(t) for _, t, src, *_ in rows if src == s and t]
        assert Counter(stream) == Counter(x for w in want for x in w)
        text = "|".join(map(str, stream))
        assert all("|".join(map(str, w)) in text for w in want)


def test_blocks_of_documents_of_any_size_and_split(spark):
    rows = [(i, "a b" * n, "big" if i % 3 else "small", "", 1) for i, n in enumerate([1, 400, 3, 0, 2, 9, 9, 150, 1, 1, 1, 60] * 4)]
    encode = encoder(VOCABULARY).encode_ordinary
    for parts in (1, 7):
        got = source_blocks(spark.createDataFrame(rows, DOCS).repartition(parts, "doc_id"), ["big", "small"], block_tokens=8).collect()
        for s in ("big", "small"):
            own = sorted((r["block_index"], r["n_tokens"], r["tokens"]) for r in got if r["source"] == s)
            assert [i for i, *_ in own] == list(range(len(own))) and all(n == len(t) == 8 for _, n, t in own[:-1]) and own[-1][1] == len(own[-1][2])
            assert Counter(x for *_, t in own for x in t) == Counter(x for _, t, src, *_ in rows if src == s for x in encode(t))


def test_mix(spark):
    docs, _ = made(spark)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 5), ("other", None, 2), (None, 0.2, 1)], TARGETS)
    mixture, shares = mix(docs, targets, block_tokens=16, shard_blocks=8)
    got = mixture.collect()
    blocks = {(r["source"], r["block_index"]): r["tokens"] for r in source_blocks(docs, ["big", "none", "other", "small"], block_tokens=16).collect()}
    use = Counter((r["source"], r["block_index"]) for r in got)
    assert all(blocks[r["source"], r["block_index"]] == r["tokens"] for r in got)
    assert max(n for (s, _), n in use.items() if s == "small") <= 3 and max(n for (s, _), n in use.items() if s == "big") == 1
    assert len({(r["out_shard"], r["slot"]) for r in got}) == len(got)
    for shard in {r["out_shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["out_shard"] == shard)
        assert slots == list(range(len(slots)))
    report = {r["source"]: r for r in shares.collect()}
    assert set(report) == {"big", "small", "none", "other"}
    assert abs(report["big"]["actual_share"] - 2 / 3) < 0.03 and report["none"]["actual_share"] == 0 == report["other"]["drawn_tokens"]
    assert sum(r["drawn_tokens"] for r in report.values()) == sum(r["n_tokens"] for r in got)
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9


def test_same_seed_same_mixture(spark):
    docs, _ = made(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS)
    a, b, c = (
        sorted((r["out_shard"], r["slot"], r["source"], r["block_index"]) for r in mix(docs, targets, block_tokens=16, seed=s)[0].collect()) for s in (1, 1, 2)
    )
    assert a == b != c


def test_production_shares(spark, data):
    _, shares = mix(load(spark, data, "documents"), load(spark, data, "mix_targets"), block_tokens=64)
    got = shares.collect()
    assert len(got) == 8
    live = [r for r in got if r["source_tokens"] > 0]
    whole = sum(r["target_share"] for r in live)
    assert all(r["repeats"] <= r["max_repeats"] for r in got)
    assert max(abs(r["actual_share"] - r["target_share"] / whole) for r in live) < 0.1


def test_empty(spark):
    docs, _ = made(spark)
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    for d, t in ((docs.where("false"), targets), (docs, targets.where("false"))):
        mixture, shares = mix(d, t)
        assert mixture.count() == 0 and shares.count() == t.count()


def test_scarce_source_does_not_shrink_a_mixture_of_corpus_size(spark):
    docs, _ = made(spark)
    targets = spark.createDataFrame([("big", 0.5, 4), ("small", 0.5, 1)], TARGETS)
    least = {r["source"]: r for r in mix(docs, targets, block_tokens=16)[1].collect()}
    whole = {r["source"]: r for r in mix(docs, targets, block_tokens=16, of_corpus=1.0)[1].collect()}
    have = sum(r["source_tokens"] for r in whole.values())
    assert least["big"]["drawn_tokens"] < least["big"]["source_tokens"]
    assert abs(sum(r["drawn_tokens"] for r in whole.values()) - have) <= 32
    assert whole["small"]["drawn_tokens"] == whole["small"]["source_tokens"] and whole["small"]["actual_share"] < 0.5
