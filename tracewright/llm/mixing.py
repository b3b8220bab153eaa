"""Sources combined to target shares of all tokens, small ones repeated up to a cap.

Each source's tokens, end to end in the order of the scan, are cut into fixed-length blocks with an
index: where a document begins in its source follows from a running sum inside each scan task and
the sums of the tasks before, so blocks are cut where the tokens lie, and only those that two tasks
share are put together. Every output shard draws its source counts from a multinomial over the
quotas still open, by halving the shards: each task draws the halves on the way to its shard under the same keys, so
the quotas are met exactly without a plan on the driver. The draws of a source are numbered through
all shards; number j is block perm(j mod blocks) of the source's pass j div blocks, under a
pseudorandom permutation of the source's block indices, so each block comes once before any comes
again. Slots and blocks then meet in a join on (source, block index), the one time that tokens travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.tokens import VOCABULARY, encoder
from tracewright.session import cut

BLOCK_TOKENS = 512
MAX_SOURCES = 1000
SHARD_BLOCKS = 1024


def permuted(i: np.ndarray, size: int, key: int) -> np.ndarray:
    """The images of indices 0 <= i < size under a keyed pseudorandom permutation of that range.

    A four-round Feistel network over the smallest even number of bits; values outside the range
    walk on until they fall inside.
    """
    half = np.uint64(max(1, (max(1, size - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & low
        for r in range(4):
            mixed = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % 2**64)) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & low)
        x = (left << half) | right
        out[todo] = x
        todo = todo[x >= size]
    return out.astype(np.int64)


def quotas(shares: np.ndarray, blocks: np.ndarray, repeats: np.ndarray, total: int | None = None) -> np.ndarray:
    """Slots of each source: target shares among sources that have blocks, none beyond repeats x blocks.

    Without ``total`` it is the largest at which every such source still reaches its share under
    its cap. With a larger one, a source at its cap stays there and the others keep their
    proportions.
    """
    able = (blocks > 0) & (shares > 0) & (repeats > 0)
    out = np.zeros(len(shares), np.int64)
    if not able.any():
        return out
    cap = np.where(able, blocks * repeats, 0)
    part = np.where(able, shares, 0.0)
    if total is None:
        total = max(1, int(np.floor((cap[able] / (part[able] / part.sum())).min() + 1e-9)))
    open_, left = able.copy(), min(int(total), int(cap.sum()))
    while left and open_.any():
        p = np.where(open_, part, 0.0)
        ideal = left * p / p.sum()
        give = np.floor(ideal + 1e-9).astype(np.int64)
        rest = left - int(give.sum())
        for k in np.argsort(-(ideal - give), kind="stable")[:rest]:
            give[k] += 1
        full = out + give >= cap
        give = np.where(full, cap - out, give)
        out += give
        left -= int(give.sum())
        open_ &= ~full
    return out


def _half(left: np.ndarray, n: int, key: int) -> np.ndarray:
    """``n`` draws out of what is left of each source, multinomial over what is still open."""
    rng, got = np.random.default_rng(key), np.zeros_like(left)
    while (need := n - int(got.sum())) > 0:
        open_ = left - got
        got += np.minimum(rng.multinomial(need, open_ / open_.sum()), open_)
    return got


def shard_draw(quota: np.ndarray, shard_blocks: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, start): the source counts of one shard of ``shard_blocks`` slots, and those of all shards before it.

    The shards are halved until one is left; both halves of a range of shards share out its counts
    the same way wherever they are drawn, so over all shards the counts add up to the quotas.
    """
    left, start = quota.astype(np.int64).copy(), np.zeros(len(quota), np.int64)
    lo, hi = 0, -(-int(left.sum()) // shard_blocks)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _half(left, (mid - lo) * shard_blocks, _key(seed, lo, hi))
        if shard < mid:
            left, hi = first, mid
        else:
            left, start, lo = left - first, start + first, mid
    return left, start


_CODED = pa.schema([("source", pa.string()), ("part", pa.int32()), ("inner", pa.int64()), ("tokens", pa.list_(pa.int32()))])


def _coded(path: str):
    """(source, text) to tokens, each with its place among those of its source in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, upto = encoder(path).encode_ordinary, TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = encode(text)
                if tokens:
                    at = upto.get(source, 0)
                    rows.append((source, part, at, tokens))
                    upto[source] = at + len(tokens)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CODED)], schema=_CODED)

    return run


_PIECES = pa.schema([("source", pa.string()), ("block_index", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32()))])


def _gridded(size: int):
    """(source, at, tokens) to pieces of blocks: whole ones wherever the tokens of one follow one another here, else what there is of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, list[np.ndarray], int]] = {}  # source: where its held tokens begin, those tokens, how many
        out: list[tuple[str, int, np.ndarray]] = []

        def put(source: str, at: int, tokens: np.ndarray) -> None:
            for a in range(0, len(tokens), size):
                out.append((source, at + a, tokens[a : a + size]))

        def batch_of() -> pa.RecordBatch:
            sources, at, parts = zip(*out)
            ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            cols = [pa.array(sources), pa.array([x // size for x in at], pa.int64()), pa.array(at, pa.int64()), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))]
            out.clear()
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _PIECES)], schema=_PIECES)

        for batch in batches:
            lists = batch.column(2)
            ends, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for i, (source, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                tokens = values[ends[i] : ends[i + 1]]
                begin, parts, n = held.pop(source, (at, [], 0))
                if begin + n != at:  # what is held goes on elsewhere
                    put(source, begin, np.concatenate(parts))
                    begin, parts, n = at, [], 0
                parts, n = [*parts, tokens], n + len(tokens)
                rest = begin + n - max(begin, (begin + n) // size * size)  # what lies beyond the last bound
                if rest < n:
                    joined = np.concatenate(parts)
                    head = min(n - rest, -begin % size)
                    if head:
                        put(source, begin, joined[:head])
                    put(source, begin + head, joined[head : n - rest])
                    begin, parts, n = begin + n - rest, [joined[n - rest :]], rest
                if n:
                    held[source] = (begin, parts, n)
            if out:
                yield batch_of()
        for source, (begin, parts, _) in held.items():
            put(source, begin, np.concatenate(parts))
        if out:
            yield batch_of()

    return run


def source_blocks(documents: DataFrame, sources: list[str], vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(source, block_index, n_tokens, tokens): each source's tokens in fixed-length blocks; only a source's last one may be shorter.

    Documents follow one another as they are scanned; a source with most documents isn't ordered in one task.
    """
    rows = documents.where(F.col("source").isin(*sources) & (F.length("text") > 0)).select("source", "text")
    coded = cut(rows.mapInArrow(_coded(vocabulary), "source string, part int, inner long, tokens array<int>"), "coded")
    w = Window.partitionBy("source").orderBy("part")  # a row per scan task
    sums = coded.groupBy("source", "part").agg(F.sum(F.size("tokens")).alias("n"))
    starts = cut(sums.select("source", "part", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start")), "starts")
    placed = coded.join(starts, ["source", "part"]).select("source", (F.col("start") + F.col("inner")).alias("at"), "tokens")
    pieces = cut(placed.mapInArrow(_gridded(block_tokens), "source string, block_index long, at long, n_tokens int, tokens array<int>"), "pieces")
    whole = F.col("n_tokens") == block_tokens
    parts = F.array_sort(F.collect_list(F.struct("at", "tokens")))  # at most block_tokens parts
    shared = pieces.where(~whole).groupBy("source", "block_index").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.flatten(F.transform(parts, lambda x: x["tokens"])).alias("tokens"))
    return pieces.where(whole).select("source", "block_index", "n_tokens", "tokens").unionByName(shared)


def _key(*parts: int) -> int:
    """One number from several, for keying a permutation."""
    out = 0
    for p in parts:
        out = (out * 6364136223846793005 + p + 1442695040888963407) % 2**64
    return out


_SLOTS = pa.schema([("out_shard", pa.int32()), ("slot", pa.int64()), ("source", pa.string()), ("repeat_no", pa.int32()), ("block_index", pa.int64())])


def _slots(names: list[str], blocks: list[int], quota: list[int], shard_blocks: int, seed: int, step: int = 50_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts, start = shard_draw(np.array(quota, np.int64), shard_blocks, shard, seed)
                base, size = np.cumsum(counts) - counts, int(counts.sum())
                for k in np.flatnonzero(counts).tolist():
                    for a in range(0, int(counts[k]), step):
                        i = np.arange(a, min(int(counts[k]), a + step), dtype=np.int64)
                        turn, inner = np.divmod(int(start[k]) + i, blocks[k])
                        index = np.empty_like(inner)
                        for t in np.unique(turn):
                            index[turn == t] = permuted(inner[turn == t], blocks[k], _key(seed, k, int(t)))
                        place = permuted(int(base[k]) + i, size, _key(seed, len(blocks), shard))
                        cols = (np.full(len(i), shard), place, [names[k]] * len(i), turn, index)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SLOTS)], schema=_SLOTS)

    return run


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    vocabulary: str = VOCABULARY,
    block_tokens: int = BLOCK_TOKENS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 7,
    of_corpus: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of the documents whose source is listed in ``targets``.

    mixture: out_shard, slot, source, repeat_no, block_index, n_tokens, tokens. shares: source,
    target_share, max_repeats, source_tokens, drawn_tokens, actual_share, repeats.
    A listed source without tokens supplies nothing and the others share its part in proportion;
    its actual share is reported as 0. Without ``total_tokens`` the mixture is as large as the
    caps let it be with every share met, whatever that leaves out; with ``of_corpus`` it has that
    many times the blocks of all listed sources, where a source at its cap falls short of its
    share and the report shows it. Documents of unlisted or null source, and null or empty
    texts, take no part. A source listed twice counts with its first row by share and cap; null
    shares and caps count as 0.
    """
    listed = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("p"), F.coalesce("max_repeats", F.lit(0)).alias("m"))
    rows = listed.groupBy("source").agg(F.max(F.struct("p", "m")).alias("x")).select("source", "x.p", "x.m").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: r["source"])
    names = [r["source"] for r in rows]
    spark = documents.sparkSession
    blocks = source_blocks(documents, names, vocabulary, block_tokens)
    have = {r[0]: (r[1], r[2]) for r in blocks.groupBy("source").agg(F.count(F.lit(1)), F.sum("n_tokens")).collect()}
    count = np.array([have.get(n, (0, 0))[0] for n in names], np.int64)
    shares, repeats = np.array([r["p"] for r in rows], float), np.array([r["m"] for r in rows], np.int64)
    total = None if total_tokens is None else max(1, total_tokens // block_tokens)
    if of_corpus is not None:
        total = max(1, round(of_corpus * int(count.sum())))
    quota = quotas(shares, count, repeats, total)
    shards = -(-int(quota.sum()) // shard_blocks)
    slots = cut(  # written, so that the join knows its size; the optimizer can't tell how many slots a shard has
        spark.range(shards, numPartitions=max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        .mapInArrow(_slots(names, count.tolist(), quota.tolist(), shard_blocks, seed), "out_shard int, slot long, source string, repeat_no int, block_index long"),
        "slots",
    )
    mixture = slots.join(blocks, ["source", "block_index"]).select(
        "out_shard", "slot", "source", "repeat_no", "block_index", "n_tokens", "tokens"
    )
    return mixture, _shares(spark, mixture, rows, have)


def _shares(spark, mixture: DataFrame, rows: list, have: dict) -> DataFrame:
    listed = spark.createDataFrame(
        [(r["source"], float(r["p"]), int(r["m"]), int(have.get(r["source"], (0, 0))[1])) for r in rows],
        "source string, target_share double, max_repeats int, source_tokens long",
    )
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("drawn"), (F.max("repeat_no") + 1).alias("turns"))
    joined = listed.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "source_tokens", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn_tokens"), F.coalesce("turns", F.lit(0)).alias("repeats")
    )  # one row per listed source, so the window below is over a bounded table
    everything = F.sum("drawn_tokens").over(Window.partitionBy())
    return joined.withColumn("actual_share", F.when(everything > 0, F.col("drawn_tokens") / everything).otherwise(F.lit(0.0)))


def mixture_audit(mixture: DataFrame, shares: DataFrame, within: float = 0.02) -> DataFrame:
    """Per listed source what must hold of a mixture: source, target_share, max_repeats, three counts that must be 0, and as_targeted.

    n_beyond_cap: blocks drawn more often than max_repeats; n_twice_a_pass: draws of a block beyond
    the first in one pass; n_slots_twice: draws that share their shard and slot with another.
    as_targeted: the actual share is within ``within`` of the target among the sources with tokens, and 0 for one without.
    """
    drawn = cut(mixture.select("out_shard", "slot", "source", "repeat_no", "block_index"), "drawn")
    n = F.count(F.lit(1)).alias("n")
    uses = drawn.groupBy("source", "block_index").agg(n).join(shares.select("source", "max_repeats"), "source")
    beyond = uses.groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("n_beyond_cap"))
    passes = drawn.groupBy("source", "repeat_no", "block_index").agg(n).groupBy("source").agg(F.sum(F.col("n") - 1).alias("n_twice_a_pass"))
    slots = drawn.groupBy("out_shard", "slot").agg(n, F.min("source").alias("source")).groupBy("source").agg(F.sum(F.col("n") - 1).alias("n_slots_twice"))
    has = F.col("source_tokens") > 0
    whole = F.sum(F.when(has, F.col("target_share"))).over(Window.partitionBy())  # over the listed sources
    met = F.when(has, F.abs(F.col("actual_share") - F.col("target_share") / whole) < within).otherwise(F.col("actual_share") == 0)
    out = shares.select("source", "target_share", "max_repeats", met.alias("as_targeted"))
    for part in (beyond, passes, slots):
        out = out.join(part, "source", "left")
    return out.fillna(0, ["n_beyond_cap", "n_twice_a_pass", "n_slots_twice"])
