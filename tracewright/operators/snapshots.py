"""The ordered log cut into snapshots by node count, and the snapshot graphs.

A snapshot closes with the event that brings its distinct nodes to n, and the next begins; where
it closes depends on where it began. To do this in parallel, the log is cut into chunks of a fixed size. Each chunk
finds, for every start in reach of the chunk before, where the run of snapshots from there leaves
the chunk; soon all starts fall into step, so this map is a handful of ranges. Maps of neighbouring chunks compose
to one of the same form, so they go up a tree, a thousand to one, until one is left; back down, each
inner map tells its parts where their first snapshots start, and a second pass numbers the events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ordering import with_position
from tracewright.session import cut

SNAPSHOT_NODES = 5000
CHUNK_EVENTS = 200_000
FAN = 1000


def _next_starts(src: np.ndarray, dst: np.ndarray, own: int, n: int) -> tuple[list[int], bool]:
    """For each of the first ``own`` events, where the snapshot after the one begun there begins; whether all were found."""
    _, ids = np.unique(np.r_[src, dst], return_inverse=True)
    a, b = ids[: len(src)].tolist(), ids[len(src) :].tolist()
    seen = [0] * (int(ids.max()) + 1 if len(ids) else 0)
    distinct, j, out, total = 0, 0, [], len(a)
    for i in range(own):
        while distinct < n and j < total:
            for x in (a[j], b[j]):
                if not seen[x]:
                    distinct += 1
                seen[x] += 1
            j += 1
        out.append(j if distinct >= n else -1)
        for x in (a[i], b[i]):
            seen[x] -= 1
            if not seen[x]:
                distinct -= 1
    return out, -1 not in out


def _ways(n: int, chunk: int, total: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(key[0])
        pdf = pdf.sort_values("pos")
        base = c * chunk
        own = min(chunk, total - base)
        found, _ = _next_starts(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), own, n)
        at_end = base + len(pdf) >= total
        leave, cuts = [0] * own, [1] * own
        for i in range(own - 1, -1, -1):
            to = found[i]
            if to < 0:
                leave[i] = total - base if at_end else -1  # the log's end, or not within the events at hand
            elif to >= own:
                leave[i] = to
            else:
                leave[i], cuts[i] = leave[to], cuts[to] + 1
        reach = own if found[0] < 0 else min(own, found[0] + 1)
        lo = np.flatnonzero(np.r_[True, (np.diff(leave[:reach]) != 0) | (np.diff(cuts[:reach]) != 0)])
        return pd.DataFrame(
            {"unit": c, "lo": lo + base, "leave": [leave[i] + base if leave[i] >= 0 else -1 for i in lo], "cuts": [cuts[i] for i in lo]}
        )

    return run


_WAYS = "unit long, lo long, leave long, cuts long"


def _by_unit(pdf: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each unit its range starts in order, and where each leads and by how many snapshots."""
    pdf = pdf.sort_values(["unit", "lo"])
    return {int(u): (g["lo"].to_numpy(), g["leave"].to_numpy(), g["cuts"].to_numpy()) for u, g in pdf.groupby("unit", sort=False)}


def _follow(units: dict, unit: int, at: int, span: int, total: int) -> tuple[int, int]:
    """(leave, cuts) of the run that starts at ``at`` in a unit of ``span`` events, or beyond it; -1 where a snapshot is longer than a chunk."""
    if at >= min((unit + 1) * span, total):
        return at, 0
    lo, leave, cuts = units[unit]
    i = int(np.searchsorted(lo, at, side="right")) - 1
    return int(leave[i]), int(cuts[i])


def _compose(span: int, total: int):
    """The maps of the units of a group as one: every range of the first unit followed through all."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group, units = int(key[0]), _by_unit(pdf)
        order, rows = sorted(units), []
        for lo in units[order[0]][0].tolist():
            at, number = lo, 0
            for u in order:
                at, more = _follow(units, u, at, span, total)
                number += more
                if at < 0:
                    break
            if not rows or rows[-1][2:] != (at, number):
                rows.append((group, lo, at, number))
        return pd.DataFrame(rows, columns=["unit", "lo", "leave", "cuts"])

    return run


def _hand_down(span: int, total: int):
    """(unit, first, begun) of the units of a group whose own first start and snapshot number are known."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, number, units = int(pdf["first"].iloc[0]), int(pdf["begun"].iloc[0]), _by_unit(pdf)
        rows = []
        for u in sorted(units):
            rows.append((u, at, number))
            at, more = _follow(units, u, at, span, total)
            number += more
        return pd.DataFrame(rows, columns=["unit", "first", "begun"])

    return run


def _first_starts(ways: DataFrame, chunk: int, total: int, fan: int) -> DataFrame | None:
    """(unit, first, begun) of every unit: where its first snapshot starts and that one's number; None where some snapshot is longer than a chunk."""
    levels = [ways]
    group = F.floor(F.col("unit") / fan)
    while levels[-1].agg(F.max("unit")).first()[0]:
        up = levels[-1].withColumn("parent", group).groupBy("parent").applyInPandas(_compose(chunk * fan ** (len(levels) - 1), total), _WAYS)
        levels.append(cut(up, "ways"))
    if levels[-1].where("lo = 0 and leave < 0").count():
        return None
    spark = ways.sparkSession
    starts = spark.createDataFrame([(0, 0, 0)], "unit long, first long, begun long")
    for height, level in reversed(list(enumerate(levels[:-1]))):
        known = level.withColumn("parent", group).join(starts.withColumnRenamed("unit", "parent"), "parent")
        starts = cut(known.groupBy("parent").applyInPandas(_hand_down(chunk * fan**height, total), "unit long, first long, begun long"), "starts")
    return starts


def _number(n: int):
    """A chunk's events with their snapshot; its first start and that one's number stand in each row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        first, now = table["first"][0].as_py(), table["begun"][0].as_py() - 1
        out, seen = [], set()
        for pos, a, b in zip(*(table[c].to_pylist() for c in ("pos", "__src", "__dst"))):
            if pos == first or (pos > first and len(seen) >= n):
                now, seen = now + 1, set()
            if pos >= first:
                seen.add(a)
                seen.add(b)
            out.append(now)
        return table.drop_columns(["unit", "first", "begun", "__src", "__dst"]).append_column("snapshot_id", pa.array(out, pa.int32()))

    return run


def cut_snapshots(events: DataFrame, order: list[str], n: int = SNAPSHOT_NODES, chunk_events: int = CHUNK_EVENTS, fan: int = FAN) -> DataFrame:
    """``events`` with pos (0-based log position) and snapshot_id (from 0).

    ``order`` totally orders the log; src and dst are the ends of an event and must not be null. The
    last snapshot may hold fewer than n nodes. A chunk must be as long as the longest snapshot; where one is
    longer, chunks are doubled and the maps made again. Empty events give an empty result.
    """
    placed = cut(with_position(events, *order), "log")
    total, chunk = placed.count(), chunk_events
    while True:
        unit = F.floor(F.col("pos") / chunk)
        slim = placed.select("pos", F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
        both = slim.select("*", F.explode(F.array(unit, unit - 1)).alias("unit")).where("unit >= 0")
        ways = cut(both.groupBy("unit").applyInPandas(_ways(n, chunk, total), _WAYS), "ways")
        starts = _first_starts(ways, chunk, total, fan)
        if starts is not None:
            break
        chunk *= 2
    own = placed.withColumns({"unit": unit, "__src": F.xxhash64("src"), "__dst": F.xxhash64("dst")}).join(starts, "unit")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    return own.groupBy("unit").applyInArrow(_number(n), f"{schema}, snapshot_id int")


def snapshot_edges(snapped: DataFrame) -> DataFrame:
    """(snapshot_id, u, v, weight): undirected edges with the number of events between u <= v."""
    return snapped.groupBy("snapshot_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def snapshot_nodes(snapped: DataFrame) -> DataFrame:
    """(snapshot_id, node, pos): nodes in order of arrival within their snapshot, source before destination.

    The window's groups are snapshots, which hold at most n + 1 nodes.
    """
    ends = snapped.select(
        "snapshot_id",
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), (F.col("pos") * 2).alias("at")),
                F.struct(F.col("dst").alias("node"), (F.col("pos") * 2 + 1).alias("at")),
            )
        ),
    )
    first = ends.groupBy("snapshot_id", "node").agg(F.min("at").alias("at"))
    w = Window.partitionBy("snapshot_id").orderBy("at")
    return first.select("snapshot_id", "node", (F.row_number().over(w) - 1).alias("pos"))
