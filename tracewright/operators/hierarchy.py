"""Parent-child links of unknown depth to roots, depths, paths and descendants.

Every node has at most one parent, so the links are pointers. The nodes are spread by id; each
partition puts its own links into a weighted disjoint-set forest, which gives each node the last
ancestor known there (its anchor) and the steps to it. What merges are the anchors alone: the rows of the
nodes that others hang from are a smaller set of weighted links, which one more forest merges once
it fits in memory; until then every link is joined with its anchor's, so that the steps of a set
double and the anchors of a next level are fewer. Back down, each level looks its anchors up in the one above. Sets
that run into a loop beyond a partition are then told apart by their own links. Paths are made afterwards
by walking the parent index of whole trees. No links pass the driver; anchors are looked up
by the distinct ones of a bucket of nodes, so that a parent of most children is looked up once
a bucket; and each level's table is cut in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.lookup import buckets, follow
from tracewright.session import cut

TREE, CYCLE, UNDER = "tree", "cycle", "under_cycle"
OPEN, LOOPED = "open", "looped"  # not known yet; leads into a loop that isn't known yet
LINK_TYPES = ("EVENT_FORK", "EVENT_CLONE")
LOCAL_NODES = 250_000


def parent_table(
    events: DataFrame, link_types: tuple[str, ...] = LINK_TYPES, src: str = "srcid", dst: str = "dstid", etype: str = "etype", seq: str = "seq"
) -> DataFrame:
    """(node, parent): every id at either end of a link; parent is null for a node without one.

    The parent of a child is the source of its link of smallest ``seq`` (of equal ``seq``, or of
    null ``seq``, the smallest source). One aggregation, combined map side, so that neither a
    parent of most children nor a child linked over and over weighs on one task.
    """
    links = events.where(F.col(etype).isin(*link_types) & F.col(src).isNotNull() & F.col(dst).isNotNull())
    order = F.struct(F.coalesce(F.col(seq), F.lit(2**63 - 1)).alias("s"), F.col(src).cast("long").alias("p"))
    ends = links.select(
        F.inline(
            F.array(
                F.struct(F.col(dst).cast("long").alias("node"), order.alias("up")),
                F.struct(F.col(src).cast("long").alias("node"), F.lit(None).cast("struct<s:bigint,p:bigint>").alias("up")),
            )
        )
    )
    return ends.groupBy("node").agg(F.min("up").alias("up")).select("node", F.col("up.p").alias("parent"))


class WeightedForest:
    """Disjoint sets over some weighted links; each node knows its offset to its set's top."""

    def __init__(self, nodes: list[int], parents: list[int | None], steps: list[int] | None = None, loop: str = CYCLE):
        self.up = dict(zip(nodes, parents))
        self.step = dict(zip(nodes, steps)) if steps else {}
        self.loop = loop  # the state of what is on a loop of these links
        self.top: dict[int, tuple[int, int, str]] = {}

    def find(self, node: int) -> tuple[int, int, str]:
        """(anchor, offset, state) of a node; compresses the way it came."""
        way: list[int] = []
        at, here = node, {}
        while True:
            if at in self.top:
                found = self.top[at]
                break
            if at in here:  # a loop among these links
                loop = way[here[at] :]
                low = min(loop)
                for x in loop:
                    self.top[x] = (low, 0, self.loop)
                del way[here[at] :]
                found = (low, 0, self.loop)
                break
            if at not in self.up:
                found = (at, 0, OPEN)
                break
            if self.up[at] is None:
                found = self.top[at] = (at, 0, TREE)
                break
            here[at] = len(way)
            way.append(at)
            at = self.up[at]
        anchor, off, state = found
        if state == CYCLE:
            state = UNDER
        for x in reversed(way):
            off += self.step.get(x, 1)
            self.top[x] = (anchor, off, state)
        return self.top.get(node, found)


def _columns(batches: Iterator[pa.RecordBatch], n: int) -> list[list]:
    out: list[list] = [[] for _ in range(n)]
    for b in batches:
        for i in range(n):
            out[i] += b.column(i).to_pylist()
    return out


_LEVEL = "node long, anchor long, off long, state string"


def _found(forest: WeightedForest, nodes: list[int]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        anchors, offs, states = zip(*map(forest.find, part))
        cols = [pa.array(c, t) for c, t in ((part, pa.int64()), (anchors, pa.int64()), (offs, pa.int64()), (states, pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, ["node", "anchor", "off", "state"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition's links (node, parent)."""
    nodes, parents = _columns(batches, 2)
    yield from _found(WeightedForest(nodes, parents), nodes)


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of the links (node, anchor, off, state) that are left; loops among them are those of sets, not yet of nodes."""
    nodes, anchors, offs, states = _columns(batches, 4)
    forest = WeightedForest(nodes, anchors, offs, LOOPED)
    forest.top = {x: (a, off, s) for x, a, off, s in zip(nodes, anchors, offs, states) if s != OPEN}
    yield from _found(forest, nodes)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _states(df: DataFrame) -> dict[str, int]:
    return {r["state"]: r["n"] for r in df.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}


def _onward(level: DataFrame, index: DataFrame) -> DataFrame:
    """The open rows of a level, led on by what ``index`` knows of their anchors; a state of cycle is exact for its own node only."""
    state = F.when(F.col("found.state") == CYCLE, F.lit(UNDER)).otherwise(F.col("found.state"))
    met = follow(level.where(F.col("state") == OPEN), "anchor", index)
    return met.select("node", F.col("found.anchor").alias("anchor"), (F.col("off") + F.col("found.off")).alias("off"), state.alias("state"))


def _merge(level: DataFrame, local_nodes: int) -> DataFrame:
    """(node, anchor, off, state) of all nodes of a level of forests; none is open any more, but some may be looped."""
    levels = [level]
    while True:
        anchors = levels[-1].where(F.col("state") == OPEN).select(F.col("anchor").alias("node")).distinct()
        index = cut(levels[-1].join(anchors, "node", "left_semi"), "anchors")
        counts = _states(index)
        if not counts.get(OPEN):
            break
        if sum(counts.values()) <= local_nodes:
            index = cut(index.coalesce(1).mapInArrow(_last, _LEVEL), "last")
            break
        # distances to finished sets have no gaps, so a level that finishes nothing proves that the rest runs into loops
        further = cut(_union([index.where(F.col("state") != OPEN), _onward(index, index)]), "merge")
        if _states(further).get(OPEN, 0) == counts[OPEN]:
            index = index.withColumn("state", F.when(F.col("state") == OPEN, F.lit(LOOPED)).otherwise(F.col("state")))
            break
        levels.append(further)
    for level in reversed(levels):
        index = cut(_union([level.where(F.col("state") != OPEN), _onward(level, index)]), "merged")
    return index


def _loops(links: DataFrame) -> DataFrame:
    """(node, root): the nodes on loops of links that all lead into loops; root is the loop's smallest id."""

    def twice(step: DataFrame) -> DataFrame:
        low = F.least("low", "found.low")
        met = follow(step.select("node", "to", "low"), "to", step.select("node", "to", "low"))
        return cut(met.select("node", F.col("found.to").alias("to"), low.alias("low"), (low != F.col("low")).alias("moved")), "loop")

    step = cut(links.select("node", F.col("parent").alias("to"), F.col("node").alias("low")), "loop")
    image = step.select("to").distinct().count()
    while True:
        step = twice(step)
        now = step.select("to").distinct().count()
        if now == image:
            break
        image = now
    on = step.select(F.col("to").alias("node")).distinct()
    step = cut(step.join(on, "node", "left_semi"), "loop")
    while True:
        step = twice(step)
        if not step.where("moved").limit(1).count():
            return step.select("node", F.col("low").alias("root"))


_IDS = 500_000


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity_id, path) of (entity_id, parent, depth) of whole trees."""
    nodes, parents, depths = _columns(batches, 3)
    up = dict(zip(nodes, parents))

    def batch_of(ids: list[int], paths: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], ["entity_id", "path"])

    ids, paths, size = [], [], 0
    for node, depth in zip(nodes, depths):
        path = [node]
        for _ in range(depth):
            path.append(up[path[-1]])
        ids.append(node)
        paths.append(path[::-1])
        size += depth + 1
        if size >= _IDS:
            yield batch_of(ids, paths)
            ids, paths, size = [], [], 0
    if ids:
        yield batch_of(ids, paths)


def _doubled(level: DataFrame) -> DataFrame:
    """(entity_id, path) of (node, up, path): each node begins with itself and, in each round, puts before its ids those of the node above them."""
    level, done = cut(level, "paths"), []
    while True:
        done.append(level.where("up is null"))
        still = level.where("up is not null")
        if still.isEmpty():
            return _union(done).select(F.col("node").alias("entity_id"), "path")
        met = follow(still, "up", _union([still, *done]))
        level = cut(met.select("node", F.col("found.up").alias("up"), F.concat("found.path", "path").alias("path")), "paths")


def _with_paths(found: DataFrame, parents: DataFrame, local_nodes: int) -> DataFrame:
    """``found`` (entity_id, root_id, depth, ...) with path: the ids from the node of depth 0 down to the node.

    Trees of at most ``local_nodes`` nodes come together whole and are walked upwards; a path in a larger one
    is made in as many rounds of joins as the logarithm of its length.
    """
    found = cut(found, "found")
    large = cut(found.groupBy("root_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local_nodes).select("root_id"), "large")
    links = found.join(parents.withColumnRenamed("node", "entity_id"), "entity_id").select("entity_id", "parent", "depth", "root_id")
    spread = max(buckets(found), -(-found.count() // local_nodes))
    whole = links.join(large, "root_id", "left_anti").repartition(spread, "root_id").select("entity_id", "parent", "depth")
    paths = whole.mapInArrow(_walks, "entity_id long, path array<long>")
    if not large.isEmpty():
        up = F.when(F.col("depth") > 0, F.col("parent"))
        of = links.join(large, "root_id", "left_semi").select(F.col("entity_id").alias("node"), up.alias("up"), F.array("entity_id").alias("path"))
        paths = paths.unionByName(_doubled(of))
    return found.join(paths, "entity_id")


def _exact_loops(links: DataFrame, local_nodes: int) -> DataFrame:
    """(node, anchor, off, state) of links that all lead into loops."""
    if links.count() <= local_nodes:
        return links.coalesce(1).mapInArrow(_local, _LEVEL)
    loops = cut(_loops(links), "loops")
    on = loops.select("node", F.col("root").alias("anchor"), F.lit(0).cast("long").alias("off"), F.lit(CYCLE).alias("state"))
    below = links.join(loops, "node", "left_anti").select("node", F.col("parent").alias("anchor"), F.lit(1).cast("long").alias("off"), F.lit(OPEN).alias("state"))
    return _merge(cut(on.unionByName(below), "below"), local_nodes)


def resolve_forest(parents: DataFrame, with_path: bool = False, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """Root, depth and link state of every node of a (node, parent) table.

    Output: entity_id, root_id, depth, link_state, and with ``with_path`` the ids from the root
    down to the node. 'tree': root_id is the ancestor without a parent. 'cycle': the node is its
    own ancestor; root_id is the smallest id of its loop, depth 0, path the node alone.
    'under_cycle': depth counts the steps to the loop, the path starts at the loop's node that is
    reached first. There are at least as many forests as shuffle partitions; ``local_nodes`` is
    about how many nodes one holds in memory at most. An empty table gives an empty result.
    """
    parents = cut(parents, "parents")
    spread = parents.repartition(max(buckets(parents), -(-parents.count() // local_nodes)), "node")
    found = _merge(cut(spread.mapInArrow(_local, _LEVEL), "forest"), local_nodes)
    looped = found.where(F.col("state") == LOOPED)
    if not looped.isEmpty():
        links = cut(parents.join(looped.select("node"), "node", "left_semi"), "links")
        found = found.where(F.col("state") != LOOPED).unionByName(_exact_loops(links, local_nodes))
    out = found.select(F.col("node").alias("entity_id"), F.col("anchor").alias("root_id"), F.col("off").alias("depth"), F.col("state").alias("link_state"))
    return _with_paths(out, parents, local_nodes).select(*out.columns, "path") if with_path else out


def hierarchy(events: DataFrame, link_types: tuple[str, ...] = LINK_TYPES, with_path: bool = False) -> DataFrame:
    """Roots and depths of all processes that take part in a fork or clone event.

    Rows with a null end or another etype are no links, whatever their other columns hold.
    """
    return resolve_forest(parent_table(events, link_types), with_path)


def loop_places(paths: DataFrame, parents: DataFrame) -> DataFrame:
    """(root_id, node, place, size) of each node on a loop: its steps from the loop's smallest id, and the loop's length.

    Each loop is opened at its smallest id, so that the places are depths of a tree.
    """
    on = paths.where(F.col("link_state") == CYCLE).select(F.col("entity_id").alias("node"), "root_id")
    opened = parents.join(on, "node").select("node", F.when(F.col("node") != F.col("root_id"), F.col("parent")).alias("parent"))
    places = cut(resolve_forest(opened).select("root_id", F.col("entity_id").alias("node"), F.col("depth").alias("place")), "places")
    return places.join(places.groupBy("root_id").agg(F.count(F.lit(1)).alias("size")), "root_id")


def descendants(paths: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for all ancestors of each node.

    The ancestors on a node's path, and with ``parents``, the (node, parent) table of the paths,
    the loop that the path begins on: every node of a loop is an ancestor of all nodes on the loop
    (of itself at the loop's length) and of all below it, at the steps of the shortest way. The
    rows are as many as the answer has pairs. Without ``parents`` only the paths are read.
    """
    at = paths.select(F.col("entity_id").alias("descendant_id"), F.size("path").alias("n"), F.posexplode("path").alias("i", "ancestor_id"))
    found = at.where(F.col("i") < F.col("n") - 1).select(
        "ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("i")).cast("long").alias("distance")
    )
    if parents is None:
        return found
    places = cut(loop_places(paths, parents), "loop_places")
    entries = paths.where(F.col("link_state") != TREE).select(F.col("entity_id").alias("descendant_id"), "depth", F.col("path")[0].alias("node"))
    below = entries.join(places, "node").withColumnRenamed("node", "entry").withColumnRenamed("place", "entry_place")
    around = below.join(places.select("root_id", F.col("node").alias("ancestor_id"), "place"), "root_id")
    steps = F.pmod(F.col("entry_place") - F.col("place"), F.col("size"))
    own = F.col("ancestor_id") == F.col("entry")
    return found.unionByName(
        around.where(~own | (F.col("depth") == 0)).select(  # an entry is on the paths below it already
            "ancestor_id", "descendant_id", (F.col("depth") + F.when(own, F.col("size")).otherwise(steps)).alias("distance")
        )
    )
