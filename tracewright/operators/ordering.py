"""Positions and running sums in a total order without sending all rows through one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut

_ROW = (1 << 33) - 1  # the part of a generated id that counts rows within a partition


def _ranged(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``df`` range partitioned and sorted, with __tw_part and __tw_row; written, so that both stay as they are."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__tw_id", F.monotonically_increasing_id()), "placed")
    row = F.col("__tw_id").bitwiseAND(F.lit(_ROW))
    return placed.withColumn("__tw_part", F.shiftright("__tw_id", 33)).withColumn("__tw_row", row).drop("__tw_id")


def _with_starts(placed: DataFrame, size) -> DataFrame:
    """``placed`` with __tw_start, the sum of ``size`` over the partitions before; one number a partition passes the driver."""
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__tw_part").agg(size).collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = placed.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "__tw_part long, __tw_start long")
    return placed.join(F.broadcast(offsets), "__tw_part")


def with_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """``df`` with the 0-based position of each row in the order of the given columns.

    Rows are range partitioned and sorted; positions within partitions are shifted by the sizes of
    the partitions before. Rows equal in all order columns follow one another in no defined order.
    An existing column ``name`` is replaced.
    """
    kept = [c for c in df.columns if c != name]
    placed = _with_starts(_ranged(df, order), F.count(F.lit(1)))
    return placed.withColumn(name, F.col("__tw_start") + F.col("__tw_row")).select(*kept, name)


def with_running_sum(df: DataFrame, value: str, *order: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row in the order of the given columns.

    The window's groups are range partitions.
    """
    kept = [c for c in df.columns if c != name]
    placed = _with_starts(_ranged(df, order), F.sum(value))
    w = Window.partitionBy("__tw_part").orderBy("__tw_row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(name, F.col("__tw_start") + F.coalesce(F.sum(value).over(w), F.lit(0))).select(*kept, name)


def first_seen_index(edges: DataFrame, *order: str) -> DataFrame:
    """(node, idx): nodes numbered from 0 as they first appear along the order of the edges (src, dst), source before destination."""
    placed = with_position(edges.select("src", "dst", *(c for c in order if c not in ("src", "dst"))), *order, name="__at")
    ends = placed.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), (2 * F.col("__at")).alias("at")), F.struct(F.col("dst").alias("node"), (2 * F.col("__at") + 1).alias("at"))
            )
        )
    )
    first = ends.where("node is not null").groupBy("node").agg(F.min("at").alias("at"))
    return with_position(first, "at", name="idx").select("node", "idx")
