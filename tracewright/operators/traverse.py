"""From a point of interest outwards: community expansion, breadth-first search, components.

All points of interest advance together. What a hop adds is cut in the shared folder, one table a
hop, and the next starts from it; nodes and hits are counted once, after the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.lookup import follow
from tracewright.operators.ordering import with_position
from tracewright.session import cut

MAX_POI, MAX_HOP = 20, 12


def poi_sample(attack: DataFrame, subjects: DataFrame, most: int = MAX_POI) -> DataFrame:
    """(poi): up to ``most`` attack subjects, evenly spaced by id; all attack nodes where none is a subject.

    Both inputs are (node), distinct. The sample is the operator's feature.
    """
    pool = cut(attack.join(subjects, "node", "left_semi"), "pool")
    n = pool.count()
    if not n:
        pool, n = attack, attack.count()
    if n <= most:
        return pool.select(F.col("node").alias("poi"))
    step = n / float(most)
    wanted = [int(i * step) for i in range(most)]
    return with_position(pool, "node").where(F.col("pos").isin(wanted)).select(F.col("node").alias("poi"))


def expand(pois: DataFrame, members: DataFrame, attack: DataFrame, hub: int | None = None, max_hop: int = MAX_HOP) -> tuple[DataFrame, DataFrame]:
    """Community traversal: (curve, visits).

    curve: (poi, hop, communities_open, candidate_nodes, gt_covered); visits: (poi, label, hop).
    Hop 0 opens the labels of the point itself; each hop opens all labels of the candidate
    nodes that have more than one, and with ``hub`` at most that many. A point stops at full recall, when
    nothing is left to open, or at ``max_hop``. A point without a label has no rows. members is
    (node, label), attack (node).
    """
    many = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1" + (f" and n <= {int(hub)}" if hub is not None else ""))
    members = cut(members.select("node", "label"), "members")
    doors = cut(members.join(many.select("node"), "node", "left_semi"), "doors")
    marks = cut(members.join(attack.select("node").distinct(), "node", "left_semi"), "attack")  # labels of attack nodes
    goal = marks.select("node").distinct().count()
    fresh = cut(pois.join(members.withColumnRenamed("node", "poi"), "poi").select("poi", "label", F.lit(0).alias("hop")), "open")
    opened, hop = fresh, 0
    while hop < max_hop and not fresh.isEmpty():
        hop += 1
        covered = opened.join(marks, "label").groupBy("poi").agg(F.count_distinct("node").alias("c"))
        done = covered.where(F.col("c") >= goal if goal else F.lit(False)).select("poi")
        through = fresh.join(done, "poi", "left_anti").join(doors, "label").select("poi", "node").distinct()
        onward = through.join(doors, "node").select("poi", "label").distinct().join(opened, ["poi", "label"], "left_anti")
        fresh = cut(onward.withColumn("hop", F.lit(hop)), "open")
        opened = opened.unionByName(fresh)
    cand = opened.join(members, "label").groupBy("poi", "node").agg(F.min("hop").alias("hop"))
    attack = marks.select("node").distinct()
    count = F.count(F.lit(1))
    labels = opened.groupBy("poi", "hop").agg(count.alias("labels"))
    nodes = cand.join(attack.withColumn("hit", F.lit(1)), "node", "left").groupBy("poi", "hop").agg(count.alias("nodes"), F.count("hit").alias("hits"))
    rows = labels.join(nodes, ["poi", "hop"], "left").fillna(0, ["nodes", "hits"])
    w = Window.partitionBy("poi").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)  # at most max_hop + 1 rows
    sums = [F.sum(a).over(w).alias(b) for a, b in (("labels", "communities_open"), ("nodes", "candidate_nodes"), ("hits", "gt_covered"))]
    return rows.select("poi", "hop", *sums), opened


def curve_summary(curve: DataFrame, goal: int) -> DataFrame:
    """Per point: the last hop, the hop at which its coverage is final, that coverage, and the hop of full recall."""
    best = Window.partitionBy("poi")
    top = curve.withColumn("final", F.max("gt_covered").over(best))
    return top.groupBy("poi").agg(
        F.max("hop").alias("last_hop"),
        F.min(F.when(F.col("gt_covered") == F.col("final"), F.col("hop"))).alias("recall_plateau_hop"),
        F.max("final").alias("final_covered"),
        F.max("candidate_nodes").alias("final_nodes"),
        F.min(F.when(F.col("gt_covered") == F.lit(goal), F.col("hop"))).alias("full_recall_hop"),
    )


def median_poi(summary: DataFrame) -> DataFrame:
    """The point in the middle by (hops, candidates): of those that reach full recall, else of all by their last hop.

    A summary has one row per point of interest, which the sample bounds.
    """
    some = F.max(F.col("full_recall_hop").isNotNull()).over(Window.partitionBy())
    pool = summary.withColumn("some", some).where(F.col("full_recall_hop").isNotNull() | ~F.col("some"))
    w = Window.orderBy(F.coalesce("full_recall_hop", "last_hop"), "final_nodes", "poi")
    ranked = pool.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("i") == F.floor(F.col("n") / 2)).select("poi", "last_hop", "full_recall_hop", "final_nodes", "final_covered")


def bfs(pois: DataFrame, edges: DataFrame, attack: DataFrame, max_hop: int = MAX_HOP) -> DataFrame:
    """(poi, hop, visited, gt_covered): breadth-first search on the union of all snapshot graphs.

    A point stops at full recall, at ``max_hop`` or when its frontier is empty, which is a hop of
    its own. edges is any (u, v); a point that isn't in the graph has no rows.
    """
    both = cut(edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).distinct(), "adjacency")
    nodes = both.select(F.col("u").alias("node")).distinct()
    attack = cut(attack.join(nodes, "node", "left_semi"), "attack")
    goal = attack.count()
    fresh = cut(pois.join(nodes.withColumnRenamed("node", "poi"), "poi", "left_semi").select("poi", F.col("poi").alias("node")), "frontier")
    fresh = fresh.withColumn("hop", F.lit(0))
    seen, hop = fresh, 0
    while hop < max_hop and not fresh.isEmpty():
        hop += 1
        covered = seen.join(attack, "node", "left_semi").groupBy("poi").agg(F.count(F.lit(1)).alias("c"))
        done = covered.where(F.col("c") >= goal if goal else F.lit(False)).select("poi")
        step = fresh.drop("hop").join(done, "poi", "left_anti").join(both.withColumnRenamed("u", "node"), "node")
        step = step.select("poi", F.col("v").alias("node")).distinct()
        fresh = cut(step.join(seen, ["poi", "node"], "left_anti").withColumn("hop", F.lit(hop)), "frontier")
        seen = seen.unionByName(fresh)
    found = seen.join(attack.withColumn("hit", F.lit(1)), "node", "left").groupBy("poi", "hop")
    found = found.agg(F.count(F.lit(1)).alias("nodes"), F.count("hit").alias("hits"))
    w = Window.partitionBy("poi").orderBy("hop")  # at most max_hop + 1 rows
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = found.select("poi", "hop", F.sum("nodes").over(upto).alias("visited"), F.sum("hits").over(upto).alias("gt_covered"), F.lead("hop").over(w).alias("next"))
    open_ = (F.col("gt_covered") < goal) if goal else F.lit(True)
    empty = rows.where(F.col("next").isNull() & open_ & (F.col("hop") < max_hop)).withColumn("hop", F.col("hop") + 1)  # an empty frontier is a hop of its own
    return rows.unionByName(empty).select("poi", "hop", "visited", "gt_covered")


def components(members: DataFrame) -> DataFrame:
    """(label, component): labels connected through shared nodes; a component is named by its smallest label.

    Every node points its labels at its smallest one; labels then take the smallest name among
    themselves and their neighbours, and follow the name's own name, until none changes. Names
    only shrink and the pointers halve the way, so rounds are few even on long chains.
    """
    least = members.groupBy("node").agg(F.min("label").alias("to"))
    star = members.join(least, "node").select("label", "to").where("label <> to").distinct()
    both = cut(star.unionByName(star.select(F.col("to").alias("label"), F.col("label").alias("to"))), "star")
    names = cut(members.select("label").distinct().select("label", F.col("label").alias("name")), "names")
    both = both.withColumnRenamed("label", "node")
    while True:
        index = names.select(F.col("label").alias("node"), "name")
        near = follow(both, "to", index).groupBy(F.col("node").alias("label")).agg(F.min("found.name").alias("near"))
        low = names.join(near, "label", "left").select("label", F.col("name").alias("old"), F.least("name", F.coalesce("near", "name")).alias("low"))
        low = cut(low.withColumnRenamed("label", "node"), "low")
        jump = follow(low, "low", low.select("node", F.col("low").alias("next")))
        names = cut(jump.select(F.col("node").alias("label"), "old", F.least("low", "found.next").alias("name")), "names")
        changed = names.where("name <> old").limit(1).count()
        names = names.select("label", "name")
        if not changed:
            return names.select("label", F.col("name").alias("component"))


def component_histogram(named: DataFrame) -> DataFrame:
    """(component, labels): components by number of labels."""
    return named.groupBy("component").agg(F.count(F.lit(1)).alias("labels"))
