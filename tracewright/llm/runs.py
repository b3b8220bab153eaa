"""Runs of identical or near-identical consecutive events, collapsed to one event each.

Events are range partitioned once by (source, time, log position) with sampled quantiles, so that
neither a source nor a group of copies that holds a third of the log weighs on one task. In blocks
of the sorted rows second deliveries are dropped, and a run of one object is where the row number within
the source minus the row number within (source, type, object) is constant. Most of these runs are
final there and then. Only a run that stands close beside one of the same type on another object is
in doubt, and a block's first and last: these look up their objects, by the distinct objects of a partition, so
that an object of most events is looked up once a partition. The difference of row numbers is
then taken again over the canonical objects, and what touches the edge of a block is stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut

NO_ATTR = ("", "null", "none", "<unknown>")
GAP_NS = 60_000_000_000
BLOCK_ROWS = 250_000


def object_keys(entities: DataFrame) -> DataFrame:
    """(dstid, by_uuid, by_look): digests (16 bytes) under which two entities are the same object if either is equal.

    by_uuid: of the uuid. by_look: of a file's attribute with every run of the digits 0-9 as one
    sign, or of a socket's of exactly four fields without the second. Null attributes and the
    stand-ins of ``NO_ATTR`` have no look, a null uuid has no digest; entities with neither aren't
    listed. Of several rows of one entity_id the smallest digests count.
    """
    real = ~F.col("attr").isin(*NO_ATTR)
    four = F.split("attr", ",", -1)
    look = F.when(real & (F.col("cls") == "file"), F.concat(F.lit("f"), F.regexp_replace("attr", "[0-9]+", "\u0001"))).when(
        real & (F.col("cls") == "socket") & (F.size(four) == 4),
        F.concat(F.lit("s"), F.concat_ws("\u0001", four[0], four[2], four[3])),
    )
    keys = entities.where(F.col("entity_id").isNotNull()).select(
        F.col("entity_id").alias("dstid"), F.unhex(F.md5("uuid")).alias("by_uuid"), F.unhex(F.md5(look)).alias("by_look")
    )
    listed = keys.where(F.col("by_uuid").isNotNull() | F.col("by_look").isNotNull())
    return listed.groupBy("dstid").agg(F.min("by_uuid").alias("by_uuid"), F.min("by_look").alias("by_look"))


def _steps(*cols: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before; True at the first row."""
    out = np.zeros(len(cols[0]), bool)
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    out[:1] = True
    return out


def _difference(entity: np.ndarray, value: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal values begins: within an entity, row number less row number within (entity, value) changes, or the value does.

    Rows come sorted by entity, so the number of a row in the table, whose start within its entity is constant, stands for that in the entity.
    """
    groups = pd.DataFrame({i: c for i, c in enumerate((entity, *value))}).groupby(list(range(len(value) + 1)), sort=False)
    return _steps(groups.ngroup().to_numpy(), np.arange(len(entity)) - groups.cumcount().to_numpy())


_EXACT = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("chain", pa.int32()), ("kind", pa.string()), ("srcid", pa.int64()), ("etype", pa.string())]
    + [(n, pa.int64()) for n in ("dstid", "first_ts", "first_seq", "last_ts", "n_events")]
    + [("at_first", pa.bool_()), ("at_last", pa.bool_())]
)
_EXACT_DDL = (
    "part int, block int, chain int, kind string, srcid long, etype string, dstid long, first_ts long, first_seq long, last_ts long, "
    "n_events long, at_first boolean, at_last boolean"
)
RUN, LEAD, TAIL = "run", "lead", "tail"


class _Partition:
    """The sorted rows of one range partition, block by block.

    The rows of the partition's first (source, time) are its lead, each a run of its own, as
    copies of them may stand in the partition before; the rows of its last (source, time) are listed
    as its tail, for the partition behind.
    """

    def __init__(self, part: int, gap_ns: int, min_run: int):
        self.part, self.gap_ns, self.min_run = part, gap_ns, min_run
        self.lead: tuple[int, int] | None = None  # (source, time) of the lead
        self.tied: tuple[int, int] | None = None  # (source, time) of the last row so far, and its events with their log position
        self.seen: dict[tuple[str, int], int] = {}
        self.block = 0

    def _drop_copies(self, src, ts, dst, seq, ety, names) -> np.ndarray:
        """Which rows stay: of rows equal in source, time, type and object only the first, which has the smallest position."""
        tie = ~_steps(src, ts)
        tie[:-1] |= tie[1:]
        keep = np.ones(len(src), bool)
        at = np.flatnonzero(tie)
        if len(at):
            keep[at] = ~pd.DataFrame({"s": src[at], "t": ts[at], "e": ety[at], "d": dst[at]}).duplicated().to_numpy()
        head = np.flatnonzero(_steps(src, ts))[1:2]
        stop = int(head[0]) if len(head) else len(src)
        if self.tied == (src[0], ts[0]):
            for i in range(stop):
                if keep[i] and (names[ety[i]], int(dst[i])) in self.seen:
                    keep[i] = False
        begin = int(np.flatnonzero(_steps(src, ts))[-1])
        if self.tied != (src[-1], ts[-1]):
            self.tied, self.seen = (int(src[-1]), int(ts[-1])), {}
        for i in range(begin, len(src)):
            if keep[i]:
                self.seen[names[ety[i]], int(dst[i])] = int(seq[i])
        return keep

    def _rows(self, kind, chain, src, ety, dst, ts, seq, last, n, first, end) -> pa.RecordBatch:
        size = len(src)
        fixed = (np.full(size, self.part), np.full(size, self.block), chain, pa.array([kind]).take(pa.array(np.zeros(size, np.int64))))
        cols = (*fixed, src, ety, dst, ts, seq, last, n, first, end)
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _EXACT)], schema=_EXACT)

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        kinds = table["etype"].combine_chunks().dictionary_encode()
        names, ety = kinds.dictionary.to_pylist(), np.asarray(kinds.indices)
        src, ts, dst, seq = (table[c].to_numpy() for c in ("srcid", "ts", "dstid", "seq"))
        keep = np.flatnonzero(self._drop_copies(src, ts, dst, seq, ety, names))
        if self.lead is None:
            self.lead = int(src[0]), int(ts[0])
        src, ts, dst, seq, ety = (c[keep] for c in (src, ts, dst, seq, ety))
        words = kinds.dictionary.cast(pa.string())
        n_lead = int(np.argmin(np.r_[(src == self.lead[0]) & (ts == self.lead[1]), False]))
        if n_lead:
            a = slice(0, n_lead)
            yes, one = np.ones(n_lead, bool), np.ones(n_lead, np.int64)
            yield self._rows(LEAD, np.full(n_lead, -1), src[a], words.take(pa.array(ety[a])), dst[a], ts[a], seq[a], ts[a], one, yes, yes)
            src, ts, dst, seq, ety = (c[n_lead:] for c in (src, ts, dst, seq, ety))
        if not len(src):
            return
        n = len(src)
        near = ~_steps(src, ety)
        near[1:] &= ts[1:] - ts[:-1] <= self.gap_ns
        start = _difference(src, [ety, dst]) | ~near
        first = np.flatnonzero(start)
        last = np.r_[first[1:], n] - 1
        size = last - first + 1
        doubt = near[first]  # close behind a run of the same type, so of another object
        chained = doubt | np.r_[doubt[1:], False]
        chain = np.where(chained, np.cumsum(~doubt), -1)
        edge_first, edge_last = first == 0, last == n - 1
        kept = np.flatnonzero((size >= self.min_run) | chained | edge_first | edge_last)
        f, z = first[kept], last[kept]
        yield self._rows(
            RUN, chain[kept], src[f], words.take(pa.array(ety[f])), dst[f], ts[f], seq[f], ts[z], size[kept], edge_first[kept], edge_last[kept]
        )
        self.block += 1

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.tied is not None and self.tied != self.lead:
            size = len(self.seen)
            (src, ts), no = self.tied, np.zeros(size, bool)
            etypes, objects = zip(*self.seen)
            at, one = np.full(size, ts), np.ones(size, np.int64)
            yield self._rows(TAIL, np.full(size, -1), np.full(size, src), pa.array(etypes, pa.string()), objects, at, list(self.seen.values()), at, one, no, no)


def _exact_runs(gap_ns: int, min_run: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Partition(TaskContext.get().partitionId(), gap_ns, min_run)
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= block_rows:
                yield from own.add(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield from own.add(pa.Table.from_batches(held))
        yield from own.end()

    return run


_MERGED = pa.schema(
    [("srcid", pa.int64()), ("etype", pa.string())]
    + [(n, pa.int64()) for n in ("dstid", "first_ts", "first_seq")]
    + [("f_uuid", pa.binary()), ("f_look", pa.binary()), ("l_dst", pa.int64()), ("last_ts", pa.int64()), ("l_uuid", pa.binary()), ("l_look", pa.binary())]
    + [("n_events", pa.int64()), ("at_first", pa.bool_()), ("at_last", pa.bool_())]
)
_MERGED_DDL = (
    "srcid long, etype string, dstid long, first_ts long, first_seq long, f_uuid binary, f_look binary, l_dst long, last_ts long, "
    "l_uuid binary, l_look binary, n_events long, at_first boolean, at_last boolean"
)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, -1 for null."""
    return np.asarray(column.combine_chunks().dictionary_encode().indices.fill_null(-1))


def _merge_chains(t: pa.Table) -> pa.RecordBatch:
    """Neighbouring runs of a chain whose objects are the same, as one: runs of canonical objects, then an exact check of neighbours."""
    uuid, look = _codes(t["by_uuid"]), _codes(t["by_look"])
    chain = pd.DataFrame({c: t[c].to_numpy() for c in ("part", "block", "chain")}).groupby(["part", "block", "chain"], sort=False).ngroup().to_numpy()
    rule = np.where(look >= 0, 2, np.where(uuid >= 0, 1, 0))
    canonical = np.where(look >= 0, look, np.where(uuid >= 0, uuid, t["dstid"].to_numpy()))
    start = _difference(chain, [rule, canonical])
    other = np.zeros(len(start), bool)  # the same object by uuid though its looks differ
    other[1:] = (chain[1:] == chain[:-1]) & (uuid[1:] >= 0) & (uuid[1:] == uuid[:-1])
    first = np.flatnonzero(start & ~other)
    last = np.r_[first[1:], len(start)] - 1
    f, z = pa.array(first), pa.array(last)
    n = np.add.reduceat(t["n_events"].to_numpy(), first)

    def of(name: str, at: pa.Array) -> pa.Array:
        return t[name].combine_chunks().take(at)

    cols = [of(c, f) for c in ("srcid", "etype", "dstid", "first_ts", "first_seq", "by_uuid", "by_look")]
    cols += [of(c, z) for c in ("dstid", "last_ts", "by_uuid", "by_look")] + [pa.array(n), of("at_first", f), of("at_last", z)]
    return pa.RecordBatch.from_arrays(cols, schema=_MERGED)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains come whole: a batch's last, which may go on in the next, is held over. A chain has at most a block's rows."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        table = pa.concat_tables([held, now]) if held is not None else now
        begins = np.flatnonzero(_steps(*(table[c].to_numpy() for c in ("part", "block", "chain"))))
        if begins[-1]:
            yield _merge_chains(table.slice(0, begins[-1]).combine_chunks())
        held = table.slice(begins[-1])
    if held is not None:
        yield _merge_chains(held.combine_chunks())


def _stitch(edges: DataFrame, gap_ns: int, min_run: int) -> DataFrame:
    """Join the last run of a block with the first of the next where they continue each other."""
    w = Window.partitionBy("srcid").orderBy("first_ts", "first_seq")

    def prev(c: str):
        return F.lag(c).over(w)

    same = (
        (prev("l_dst") == F.col("dstid"))
        | F.coalesce(prev("l_uuid") == F.col("f_uuid"), F.lit(False))
        | F.coalesce(prev("l_look") == F.col("f_look"), F.lit(False))
    )
    goes_on = F.col("at_first") & prev("at_last") & (prev("etype") == F.col("etype")) & (F.col("first_ts") - prev("last_ts") <= gap_ns) & same
    numbered = edges.withColumn("starts", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn(
        "run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    head = F.min(F.struct("first_ts", "first_seq", "etype", "dstid")).alias("h")
    return (
        numbered.groupBy("srcid", "run")
        .agg(head, F.max("last_ts").alias("last_ts"), F.sum("n_events").alias("n_events"))
        .where(F.col("n_events") >= min_run)
        .select("srcid", "h.etype", "h.dstid", "h.first_seq", "h.first_ts", "last_ts", "n_events")
    )


_RUN_COLUMNS = ["srcid", "etype", "dstid", "first_seq", "first_ts", "last_ts", "n_events"]


def collapse_runs(
    events: DataFrame, entities: DataFrame, gap_ns: int = GAP_NS, min_run: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row for each run: srcid, etype, dstid, first_seq, first_ts, last_ts, n_events, duration_ns.

    Rows with a null in srcid, etype, dstid, ts or seq, or ts <= 0, take no part; of rows equal in
    srcid, etype, dstid and ts only the smallest seq does. Within a source, by ts then seq,
    neighbours continue a run if etype is equal, ts differs by at most ``gap_ns`` and their objects
    are the same (``object_keys``). etype, dstid and first_seq are those of the run's first row.
    Runs below ``min_run`` events are left out. Empty tables give an empty result.
    """
    known = F.col("srcid").isNotNull() & F.col("etype").isNotNull() & F.col("dstid").isNotNull() & F.col("seq").isNotNull() & (F.col("ts") > 0)
    order = ["srcid", "ts", "seq"]
    ranged = events.where(known).select("srcid", "etype", "dstid", "ts", "seq").repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(ranged.mapInArrow(_exact_runs(gap_ns, min_run, block_rows), _EXACT_DDL), "runs")
    edge = F.col("at_first") | F.col("at_last")
    final = found.where((F.col("kind") == RUN) & (F.col("chain") < 0) & ~edge & (F.col("n_events") >= min_run)).select(*_RUN_COLUMNS)

    once = (  # leads without the copies of what stands in a partition before, where the position is smaller
        found.where(F.col("kind").isin(LEAD, TAIL))
        .groupBy("srcid", "first_ts", "etype", "dstid")
        .agg(F.min(F.struct("first_seq", "kind", "part", "block")).alias("m"))
        .where(F.col("m.kind") == LEAD)
        .select(
            "m.part", "m.block", F.lit(-1).alias("chain"), F.lit(LEAD).alias("kind"), "srcid", "etype", "dstid", "first_ts", "m.first_seq",
            F.col("first_ts").alias("last_ts"), F.lit(1).cast("long").alias("n_events"), F.lit(True).alias("at_first"), F.lit(True).alias("at_last"),
        )
    )
    doubt = found.where((F.col("kind") == RUN) & ((F.col("chain") >= 0) | edge)).unionByName(once)
    wanted = doubt.select("part", "dstid").distinct().join(object_keys(entities), "dstid")
    looked = cut(doubt.join(wanted, ["part", "dstid"], "left"), "doubt")
    chained = (
        looked.where(F.col("chain") >= 0)
        .repartition("part", "block")
        .sortWithinPartitions("part", "block", "srcid", "first_ts", "first_seq")
        .mapInArrow(_chains, _MERGED_DDL)
    )
    merged = cut(chained, "merged")
    inner = merged.where(~edge & (F.col("n_events") >= min_run)).select(*_RUN_COLUMNS)
    lone = looked.where(F.col("chain") < 0).select(
        "srcid", "etype", "dstid", "first_ts", "first_seq", F.col("by_uuid").alias("f_uuid"), F.col("by_look").alias("f_look"), F.col("dstid").alias("l_dst"),
        "last_ts", F.col("by_uuid").alias("l_uuid"), F.col("by_look").alias("l_look"), "n_events", "at_first", "at_last",
    )
    stitched = _stitch(merged.where(edge).unionByName(lone), gap_ns, min_run)
    return final.unionByName(inner).unionByName(stitched).withColumn("duration_ns", F.col("last_ts") - F.col("first_ts"))


def collapsed_log(events: DataFrame, entities: DataFrame, gap_ns: int = GAP_NS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The whole log with its runs collapsed: ``collapse_runs``, and a row for each event that can't take part in one.

    Those are rows with a null in srcid, etype, dstid, ts or seq, or ts <= 0. They have n_events 1, ts
    as it came, and duration 0, or null without a time. Of timed ones equal in srcid, etype, dstid
    and ts (nulls equal) the smallest seq stays; without a time a second delivery can't be told
    from another event, so all stay.
    """
    timed = F.coalesce(F.col("ts") > 0, F.lit(False))
    unknown = F.col("srcid").isNull() | F.col("etype").isNull() | F.col("dstid").isNull() | F.col("seq").isNull()
    columns = ["srcid", "etype", "dstid", "ts", "seq"]
    once = events.where(timed & unknown).groupBy("srcid", "etype", "dstid", "ts").agg(F.min("seq").alias("seq")).select(*columns)
    single = once.unionByName(events.where(~timed).select(*columns))
    return collapse_runs(events, entities, gap_ns, 1, block_rows).unionByName(
        single.select(
            "srcid", "etype", "dstid", F.col("seq").alias("first_seq"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"),
            F.lit(1).cast("long").alias("n_events"), F.when(F.col("ts") > 0, F.lit(0).cast("long")).alias("duration_ns"),
        )
    )
