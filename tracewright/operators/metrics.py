"""How well communities confine an attack: candidate sets, densities, slots and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalar import ratio
from tracewright.operators.ordering import with_position, with_running_sum
from tracewright.session import cut


def event_type_counts(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(etype, n) of the considered types."""
    return events.where(F.col("etype").isin(*types)).groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


def attack_communities(last: DataFrame, attack: DataFrame) -> DataFrame:
    """(label, size, attack, density, purity): every community of last labels; attack is (node), distinct."""
    marked = last.join(attack.withColumn("hit", F.lit(1)), "node", "left")
    sized = marked.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.count("hit").alias("attack"))
    return sized.withColumn("density", F.col("attack") / F.col("size")).withColumn("purity", 1 - F.col("density"))


def candidate_metrics(last: DataFrame, attack: DataFrame) -> DataFrame:
    """One row of totals over the communities that hold attack nodes.

    The recall is that within the retrieved communities, 1 wherever any attack node is in the graph.
    """
    hit = F.col("attack") > 0
    totals = attack_communities(last, attack).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_nodes"),
        F.count(F.lit(1)).alias("total_communities"),
        F.coalesce(F.sum("attack"), F.lit(0)).alias("attack_nodes"),
        F.count_if(hit).alias("attack_communities"),
        F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).alias("involved_nodes"),
        F.coalesce(F.avg(F.when(hit, F.col("density"))), F.lit(0.0)).alias("mean_density"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_size"),
    )
    return totals.select(
        "*",
        ratio(F.col("attack_communities"), F.col("total_communities")).alias("relevant_share"),
        ratio(F.col("involved_nodes"), F.col("total_nodes")).alias("candidate_share"),
        ratio(F.col("attack_nodes"), F.col("involved_nodes")).alias("precision"),
        F.when(F.col("attack_nodes") > 0, 1.0).otherwise(0.0).alias("recall"),
    )


def top_attack_communities(last: DataFrame, attack: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` attack communities of highest density, ties by label: a report, so the limit is its feature."""
    return attack_communities(last, attack).where("attack > 0").orderBy(F.desc("density"), "label").limit(k)


def membership_slots(members: DataFrame) -> DataFrame:
    """(slots, nodes, recurring, most, extra_rows, extra_pct): what recurring nodes add to the label table."""
    per_node = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return per_node.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("slots"),
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("n") > 1).alias("recurring"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
    ).select("*", (F.col("slots") - F.col("nodes")).alias("extra_rows"), (100 * ratio(F.col("slots") - F.col("nodes"), F.col("nodes"))).alias("extra_pct"))


def hit_positions(visits: DataFrame, members: DataFrame, attack: DataFrame) -> DataFrame:
    """(poi, node, idx): the 1-based place at which each attack node is first seen.

    ``visits`` is (poi, label, hop), the order of opening hop, then label as text; inside a label
    nodes come in order of their position. Places add up from the counts of labels before and the
    rank inside the label, so no window covers all nodes of a point of interest.
    """
    seen = visits.join(members.select("label", "node", "pos"), "label")
    first = cut(seen.groupBy("poi", "node").agg(F.min(F.struct("hop", "label", "pos")).alias("at")).select("poi", "node", "at.*"), "first")
    inside = Window.partitionBy("poi", "label").orderBy("pos")
    ranked = first.withColumn("inner", F.row_number().over(inside))
    labels = first.groupBy("poi", "hop", "label").agg(F.count(F.lit(1)).alias("n"))
    summed = with_running_sum(labels, "n", "poi", "hop", "label", name="upto")
    start = summed.groupBy("poi").agg(F.min("upto").alias("start"))
    before = summed.join(start, "poi").select("poi", "label", (F.col("upto") - F.col("start")).alias("before"))
    hits = ranked.join(attack, "node", "left_semi").join(before, ["poi", "label"])
    return hits.select("poi", "node", (F.col("before") + F.col("inner")).alias("idx"))


def recall_budget(hits: DataFrame, pois: DataFrame, total_nodes: int, attack_nodes: int, budgets: tuple[float, ...], thresholds: tuple[int, ...]) -> DataFrame:
    """Per point of interest: hits within b % of all nodes, and the place that reaches r % of all attack nodes.

    Columns within_<b> (b with '_' for the point) and place_<r> (null where never reached).
    """
    rank = F.row_number().over(Window.partitionBy("poi").orderBy("idx"))  # at most one row per attack node
    ranked = hits.withColumn("k", rank)
    cols = [F.count_if(F.col("idx") <= b * total_nodes / 100.0).alias("within_" + f"{b:g}".replace(".", "_")) for b in budgets]
    cols += [F.min(F.when(F.col("k") == -(-r * attack_nodes // 100), F.col("idx"))).alias(f"place_{r}") for r in thresholds]
    found = ranked.groupBy("poi").agg(*cols)
    zero = {c: 0 for c in found.columns if c.startswith("within_")}
    return pois.select("poi").join(found, "poi", "left").fillna(zero)


def timing_stats(times: DataFrame, value: str) -> DataFrame:
    """(n, mean, deviation, median, p95, highest) of measured times; p95 is the value at index floor(0.95 n).

    Median and p95 are read off by position, so the times are never sorted in one task.
    """
    rows = with_position(times.where(F.col(value).isNotNull()).select(value), value)
    n = rows.count()
    middle = F.avg(F.when(F.col("pos").isin((n - 1) // 2, n // 2), F.col(value)))
    p95 = F.max(F.when(F.col("pos") == min(max(n - 1, 0), int(0.95 * n)), F.col(value)))
    return rows.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"),
        middle.alias("median"), p95.alias("p95"), F.max(value).alias("highest"),
    )
