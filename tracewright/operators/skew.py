"""Per-key results where a few keys hold most rows.

Rows are first combined to one row per (source, destination) pair, map side first, so copies of
one pair never travel. The pairs, seen from both sides, are then range partitioned on the
composite key (side, entity) with the partner as secondary order: the bounds are quantiles
sampled from the data, so a heavy entity spreads over as many partitions as its share asks for.
Each partition makes one partial state per entity it holds; only an entity that crosses a
partition bound has more than one, and the closing aggregation stitches these together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut


def _profile(events: DataFrame, src: str, dst: str, ts: str) -> DataFrame:
    """``entity_profile`` with a row of null entity_id for what has no id on a side."""
    timed = F.when(F.col(ts) > 0, F.col(ts))
    pairs = (
        events.select(F.col(src).alias("a"), F.col(dst).alias("b"), timed.alias("t"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    )
    seen = pairs.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(side).alias("side"), F.col(me).alias("entity_id"), F.col(other).alias("partner"), "n", "t0", "t1"
                    )
                    for side, me, other in (("src", "a", "b"), ("dst", "b", "a"))
                )
            )
        )
    )
    spread = seen.repartitionByRange("side", "entity_id", "partner")
    return (
        spread.groupBy("side", "entity_id")  # partial states inside each range, then the stitch
        .agg(
            F.sum("n").alias("n_events"),
            F.count("partner").alias("n_partners"),
            F.min("t0").alias("first_ts"),
            F.max("t1").alias("last_ts"),
        )
        .withColumn("span_ns", F.col("last_ts") - F.col("first_ts"))
    )


def entity_profile(events: DataFrame, src: str = "srcid", dst: str = "dstid", ts: str = "ts") -> DataFrame:
    """Event count, distinct partners and time span of every source and every destination.

    Output: side ('src' or 'dst'), entity_id, n_events, n_partners, first_ts, last_ts, span_ns.
    A null id is no entity and no partner, though an event with one null end counts for the other
    end. A null ``ts`` or one that isn't positive counts as an event without time; an entity
    without any time has null first_ts, last_ts and span_ns. Repeated rows count each time. An
    empty table gives an empty result. Other columns of ``events`` are ignored.
    """
    return _profile(events, src, dst, ts).where(F.col("entity_id").isNotNull())


def heavy_entities(events: DataFrame, share: float = 0.02, src: str = "srcid", dst: str = "dstid", ts: str = "ts") -> DataFrame:
    """Ids in more than ``share`` of all rows, by side: (side, entity_id).

    The share is of all rows, those with null ids included. An empty table gives no row.
    """
    counts = cut(_profile(events, src, dst, ts).select("side", "entity_id", "n_events"), "profile")
    total = counts.where("side = 'src'").agg(F.sum("n_events")).first()[0] or 0
    return counts.where(F.col("entity_id").isNotNull() & (F.col("n_events") > share * total)).select("side", "entity_id")
