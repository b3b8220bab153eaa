"""Looking up an id that a few rows or most rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def follow(rows: DataFrame, at: str, index: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with, as ``found``, the columns of the row of ``index`` whose node is their ``at``; rows without one are left out.

    What is looked up are the distinct ids of each bucket of nodes, at most one row a bucket and
    id; what comes back is joined within the bucket, so no id is hotter than its share of a bucket.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("node"), F.lit(buckets(rows))))
    asked = rows.select("_bucket", F.col(at).alias("_at")).distinct()
    answers = index.select(F.col("node").alias("_at"), F.struct(*(c for c in index.columns if c != "node")).alias("found"))
    got = asked.join(answers, "_at")
    on = (F.col("a._bucket") == F.col("b._bucket")) & (F.col(f"a.{at}") == F.col("b._at"))
    return rows.alias("a").join(got.alias("b"), on).select(*(F.col(f"a.{c}") for c in rows.columns if c != "_bucket"), "b.found")
