"""Communities of snapshot graphs: fixed-size chunks, Louvain, memberships and boundaries."""

from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.grouped import over_groups


def label(snapshot: str = "snapshot_id", index: str = "cidx"):
    """The label '<snapshot>.<community>'."""
    return F.concat_ws(".", F.col(snapshot).cast("string"), F.col(index).cast("string"))


def chunk_partition(nodes: DataFrame, size: int) -> DataFrame:
    """(snapshot_id, node, pos, label): communities of ``size`` nodes in order of arrival."""
    return nodes.withColumn("cidx", F.floor(F.col("pos") / size)).select("snapshot_id", "node", "pos", label().alias("label"))


def louvain(edges: list[tuple[int, int, float]], seed: int = 42) -> list[list[int]]:
    """Communities of one weighted undirected graph by modularity, largest gain first; ties go to the smaller community.

    Nodes are visited in an order drawn from ``seed``; a node moves only for a positive gain;
    communities become nodes until nothing moves. Communities come out by their smallest node.
    """
    adjacency: dict[int, dict[int, float]] = defaultdict(dict)
    for u, v, w in edges:
        adjacency[u][v] = adjacency[u].get(v, 0.0) + w
        if u != v:
            adjacency[v][u] = adjacency[v].get(u, 0.0) + w
    members = {u: [u] for u in adjacency}
    rng = random.Random(seed)
    while True:
        strength = {u: sum(ws.values()) + ws.get(u, 0.0) for u, ws in adjacency.items()}
        twice = sum(strength.values())
        home = {u: u for u in adjacency}
        total = dict(strength)
        order, moved_at_all = sorted(adjacency), False
        rng.shuffle(order)
        moved = twice > 0
        while moved:
            moved = False
            for u in order:
                toward: dict[int, float] = defaultdict(float)
                for v, w in adjacency[u].items():
                    if v != u:
                        toward[home[v]] += w
                old = home[u]
                total[old] -= strength[u]
                stay = toward.get(old, 0.0) - strength[u] * total[old] / twice
                best, gain = old, stay
                for c in sorted(toward):
                    here = toward[c] - strength[u] * total[c] / twice
                    if here > gain + 1e-12:
                        best, gain = c, here
                total[best] += strength[u]
                if best != old:
                    home[u], moved, moved_at_all = best, True, True
        if not moved_at_all:
            return sorted(sorted(m) for m in members.values())
        joined: dict[int, list[int]] = defaultdict(list)
        for u, c in home.items():
            joined[c] += members[u]
        bigger: dict[int, dict[int, float]] = defaultdict(dict)
        for u, ws in adjacency.items():
            a = home[u]
            bigger[a].setdefault(a, 0.0)
            for v, w in ws.items():
                b = home[v]
                if a == b:
                    w = w / 2 if u != v else w
                bigger[a][b] = bigger[a].get(b, 0.0) + w
        adjacency, members = bigger, joined


def louvain_partition(edges: DataFrame, seed: int = 42, weighted: bool = True) -> DataFrame:
    """(snapshot_id, node, label): Louvain communities of each snapshot graph (at most n + 1 nodes a task)."""

    def run(snapshot: int, group: dict[str, list]) -> list[tuple]:
        weights = map(float, group["weight"]) if weighted else [1.0] * len(group["u"])
        found = louvain(list(zip(group["u"], group["v"], weights)), seed * 1_000_003 + snapshot)
        return [(snapshot, node, f"{snapshot}.{i}") for i, c in enumerate(found) for node in c]

    arrow = pa.schema([("snapshot_id", pa.int32()), ("node", pa.int64()), ("label", pa.string())])
    return over_groups(edges.select("snapshot_id", "u", "v", "weight"), "snapshot_id", run, "snapshot_id int, node long, label string", arrow)


def seed_sweep(edges: DataFrame, seeds: tuple[int, ...] = (42, 1, 2, 3, 4)) -> DataFrame:
    """(seed, snapshot_id, communities, largest): how partitions of a snapshot vary with the seed."""
    out = None
    for s in seeds:
        sizes = louvain_partition(edges, s).groupBy("snapshot_id", "label").agg(F.count(F.lit(1)).alias("size"))
        one = sizes.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("communities"), F.max("size").alias("largest")).withColumn("seed", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.select("seed", "snapshot_id", "communities", "largest")


def membership_last(members: DataFrame) -> DataFrame:
    """(node, label): of a node in several snapshots, the label of the last."""
    return members.groupBy("node").agg(F.max_by("label", "snapshot_id").alias("label"))


def membership_multi(members: DataFrame) -> DataFrame:
    """(node, n_labels, labels): all labels in snapshot order, joined by a space. The long form, ``members``, is what operators use."""
    pairs = F.array_sort(F.collect_list(F.struct("snapshot_id", "label")))
    return members.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_labels"), F.concat_ws(" ", F.transform(pairs, lambda p: p["label"])).alias("labels")
    )


def labelled_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Snapshot edges with the labels of both ends: (snapshot_id, u, v, weight, lu, lv)."""
    at = members.select("snapshot_id", "node", "label")
    left = at.withColumnsRenamed({"node": "u", "label": "lu"})
    right = at.withColumnsRenamed({"node": "v", "label": "lv"})
    return edges.join(left, ["snapshot_id", "u"]).join(right, ["snapshot_id", "v"]).select("snapshot_id", "u", "v", "weight", "lu", "lv")


def intra_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(label, u, v): edges inside communities."""
    return labelled_edges(edges, members).where("lu = lv").select(F.col("lu").alias("label"), "u", "v")


def boundary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(snapshot_id, c1, c2, node, neighbour): edges between communities of a snapshot, from both ends; c1 is the node's."""
    e = labelled_edges(edges, members).where("lu <> lv")
    return e.select(
        "snapshot_id",
        F.inline(
            F.array(
                F.struct(F.col("lu").alias("c1"), F.col("lv").alias("c2"), F.col("u").alias("node"), F.col("v").alias("neighbour")),
                F.struct(F.col("lv").alias("c1"), F.col("lu").alias("c2"), F.col("v").alias("node"), F.col("u").alias("neighbour")),
            )
        ),
    )


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(snapshot_id, q): unweighted modularity of the partition of each snapshot; a self-loop is one neighbour."""
    e = labelled_edges(edges, members)
    loop = F.col("u") == F.col("v")
    inside = e.where("lu = lv").groupBy("snapshot_id", F.col("lu").alias("label")).agg(F.sum(F.when(loop, 1).otherwise(2)).alias("e"))
    ends = e.select("snapshot_id", F.explode(F.when(loop, F.array("lu")).otherwise(F.array("lu", "lv"))).alias("label"))
    degree = ends.groupBy("snapshot_id", "label").agg(F.count(F.lit(1)).alias("a"))
    m = edges.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("m"))
    share = degree.join(inside, ["snapshot_id", "label"], "left").join(m, "snapshot_id")
    e_part = F.coalesce(F.col("e"), F.lit(0)) / (2 * F.col("m"))
    a_part = F.col("a") / (2 * F.col("m"))
    return share.groupBy("snapshot_id").agg(F.sum(e_part - a_part * a_part).alias("q"))
