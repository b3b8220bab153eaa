"""Scalar and statistic expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordering import with_position

#: Strings that stand for a missing attribute.
STAND_INS = ("", "null", "none", "<unknown>")


def real_value(c: str) -> Column:
    """A string column with the stand-ins for a missing value as null."""
    return F.when(~F.col(c).isin(*STAND_INS), F.col(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    """Rounded to ``digits``, halves to the even digit."""
    return F.bround(c, digits)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, upper_median): the element at index n div 2 of each key's sorted non-null values.

    Found by position in one order of all keys and values, so no task sorts a key's values alone.
    """
    rows = with_position(df.where(F.col(value).isNotNull()).select(*keys, value), *keys, value, name="__at")
    n = F.count(F.lit(1)).cast("long")
    middle = rows.groupBy(*keys).agg(n.alias("n"), (F.min("__at") + F.floor(n / 2)).alias("__at"))
    return middle.join(rows.select("__at", F.col(value).alias("upper_median")), "__at").select(*keys, "n", "upper_median")


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, lowest, median, highest, n_none) of several columns; the median is the upper one."""
    pairs = df.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))))
    ends = pairs.groupBy("metric").agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.count_if(F.col("v").isNull()).alias("n_none"))
    middle = upper_median(pairs, ["metric"], "v").select("metric", F.col("upper_median").alias("median"))
    return ends.join(middle, "metric", "left").select("metric", "lowest", "median", "highest", "n_none")


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, lowest, highest, mean, deviation): deviation is the population's."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("deviation"),
    )
