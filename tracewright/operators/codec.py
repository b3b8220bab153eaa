"""Storage codecs: node orders, 4 x 4 adjacency blocks and dictionary compression."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.grouped import over_groups
from tracewright.operators.ordering import with_position

BLOCK = 4

#: The dictionary, in its order; entry i is replaced by '$i$'.
DICTIONARY = (
    "/usr", "/lib", "/etc", "/share", "bash", "/local", "/x86_64-linux-gnu", "/proc", "cache", "/python", "fluxbox", "update", "sleep",
    "config_file", "apt-config", "shell", "com_ubuntu_dists_precise_", "contentproc", "/pulseaudio", "/fonts", "/passwd", "postgresql",
    "/cmdline", "/status", "/thunderbird", "/admin", "/Downloads", "/firefox", "/Downloads", "mozilla", "/org.chromium", "/pe11scpa.default",
    "/bash_completion.d", "/entries", "/safebrowsing-updating", "/ppa.launchpad", "/us.archive.ubuntu", "/dist-packages", "/pyshared",
    "/ubuntu-mono-dark", "completion.d", "/home",
)


def degree_order(members: DataFrame, intra: DataFrame) -> DataFrame:
    """(label, node, new_idx): nodes of a community by degree, highest first, ties by node; a self-loop counts twice.

    The window's groups are communities, which a snapshot bounds.
    """
    ends = intra.select("label", F.explode(F.array("u", "v")).alias("node")).groupBy("label", "node").agg(F.count(F.lit(1)).alias("deg"))
    w = Window.partitionBy("label").orderBy(F.desc("deg"), "node")
    ranked = members.select("label", "node").join(ends, ["label", "node"], "left").fillna(0, ["deg"])
    return ranked.select("label", "node", (F.row_number().over(w) - 1).alias("new_idx"))


def arrival_order(members: DataFrame) -> DataFrame:
    """(label, node, new_idx): nodes of a community in order of arrival, the order without reordering."""
    w = Window.partitionBy("label").orderBy("pos", "node")
    return members.select("label", "node", (F.row_number().over(w) - 1).alias("new_idx"))


def cells(intra: DataFrame, order: DataFrame) -> DataFrame:
    """(label, r, c): the set cells of each community's symmetric adjacency matrix under a node order."""
    at = order.select("label", "node", "new_idx")
    e = intra.join(at.withColumnsRenamed({"node": "u", "new_idx": "r"}), ["label", "u"]).join(at.withColumnsRenamed({"node": "v", "new_idx": "c"}), ["label", "v"])
    return e.select("label", F.inline(F.array(F.struct("r", "c"), F.struct(F.col("c").alias("r"), F.col("r").alias("c")))))


def encode_blocks(matrix: DataFrame) -> DataFrame:
    """(label, br, bc, mask): non-zero 4 x 4 blocks; bit 15 - (4 row + column) of the mask is the cell."""
    bit = F.expr("shiftleft(1, 15 - (4 * (r % 4) + c % 4))")
    return matrix.groupBy("label", F.floor(F.col("r") / BLOCK).cast("int").alias("br"), F.floor(F.col("c") / BLOCK).cast("int").alias("bc")).agg(
        F.bit_or(bit).cast("int").alias("mask")
    )


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(label, r, c) of encoded blocks."""
    i = F.explode(F.sequence(F.lit(0), F.lit(15)))
    bits = blocks.select("label", "br", "bc", "mask", i.alias("i")).where(F.expr("shiftright(mask, 15 - i) & 1 = 1"))
    return bits.select("label", F.expr("br * 4 + i div 4").cast("int").alias("r"), F.expr("bc * 4 + i % 4").cast("int").alias("c"))


def decode_edges(blocks: DataFrame, order: DataFrame) -> DataFrame:
    """(label, u, v), u <= v: the edges that blocks hold, with their original nodes."""
    at = order.select("label", "node", "new_idx")
    found = decode_blocks(blocks).where("r <= c")
    e = found.join(at.withColumnsRenamed({"new_idx": "r", "node": "a"}), ["label", "r"]).join(at.withColumnsRenamed({"new_idx": "c", "node": "b"}), ["label", "c"])
    return e.select("label", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def block_text(blocks: DataFrame) -> DataFrame:
    """(label, text): a community's blocks as 'bits*row*column' joined by '#', in order of row, then column."""
    one = F.concat_ws("*", F.lpad(F.bin("mask"), 16, "0"), F.col("br").cast("string"), F.col("bc").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("br", "bc", one.alias("t"))))
    return blocks.groupBy("label").agg(F.concat_ws("#", F.transform(ordered, lambda x: x["t"])).alias("text"))


def parse_block_text(texts: DataFrame) -> DataFrame:
    """(label, br, bc, mask) of ``block_text``."""
    one = texts.select("label", F.explode(F.split("text", "#")).alias("one"))
    p = one.select("label", F.split("one", r"\*").alias("p"))
    return p.select("label", F.col("p")[1].cast("int").alias("br"), F.col("p")[2].cast("int").alias("bc"), F.conv(F.col("p")[0], 2, 10).cast("int").alias("mask"))


def block_counts(blocks: DataFrame) -> DataFrame:
    """(n_blocks, n_chars): blocks, and the characters of their undelimited form (16 bits, row, column)."""
    size = 16 + F.length(F.col("br").cast("string")) + F.length(F.col("bc").cast("string"))
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum(size), F.lit(0)).alias("n_chars"))


class SlashBurn(NamedTuple):
    """Node order from the spokes to the hubs, the rounds it took, and the hubs of a round."""

    order: list[int]
    rounds: int
    k: int


class _Burning:
    """What is left of a graph while hubs and the spokes that fall off them are taken out."""

    def __init__(self, n: int, edges: list[tuple[int, int]]):
        pairs = {(min(e), max(e)) for e in edges if e[0] != e[1]}
        self.near: list[list[int]] = [[] for _ in range(n)]
        for u, v in pairs:
            self.near[u].append(v)
            self.near[v].append(u)
        self.alive = bytearray(b"\1") * n
        self.left = n
        self.degree = [len(x) for x in self.near]
        self.known = list(self.degree)  # the degree under which a node stands in the queue
        self.queue = [(-d, v) for v, d in enumerate(self.degree)]
        heapify(self.queue)
        self.stale: list[int] = []

    def remove(self, v: int) -> None:
        self.alive[v] = 0
        self.left -= 1
        for w in self.near[v]:
            self.degree[w] -= 1
        self.stale += self.near[v]

    def requeue(self) -> None:
        for w in self.stale:
            if self.alive[w] and self.known[w] != self.degree[w]:
                self.known[w] = self.degree[w]
                heappush(self.queue, (-self.known[w], w))
        self.stale = []

    def hub(self) -> int:
        while True:
            d, v = heappop(self.queue)
            if self.alive[v] and -d == self.known[v]:
                return v

    def flood(self, v: int, room: int, met: set[int]) -> list[int] | None:
        """The nodes connected with ``v`` if they are at most ``room`` and none was met in a flood that found no end; else None."""
        inside, front = {v}, [v]
        while front:
            for w in self.near[front.pop()]:
                if self.alive[w] and w not in inside:
                    if w in met or len(inside) == room:
                        met |= inside
                        return None
                    inside.add(w)
                    front.append(w)
        return sorted(inside)


def slashburn(n: int, edges: list[tuple[int, int]], k: int | None = None, greedy: bool = True) -> SlashBurn:
    """Order of nodes 0..n-1 after Kang and Faloutsos (2011): hubs slashed, spokes burned.

    A round takes the ``k`` nodes of highest degree (a thousandth of all by default, one at least; ties to the
    smaller node) to the far end of the order. What then hangs together in less than ``k`` nodes, or
    alone, is put to the near end, small components first, then those of smaller nodes. Rounds go
    on with the rest until nothing is left. ``greedy`` counts degrees anew after each hub, otherwise after each round.

    After a round only components beside its hubs can have become small, so the search starts at the hubs'
    neighbours and gives up at ``k`` nodes, whatever the size of what goes on.
    """
    k = k or max(1, n // 1000)
    g = _Burning(n, edges)
    near_end: list[int] = []
    far_end: list[int] = []
    rounds, starts = 0, range(n)
    while g.left:
        rounds += 1
        hubs = []
        while g.left and len(hubs) < k:
            hubs.append(g.hub())
            g.remove(hubs[-1])
            if greedy:
                g.requeue()
        far_end += hubs
        if rounds > 1:
            starts = sorted({w for h in hubs for w in g.near[h]})
        spokes, seen, met = [], set(), set()
        for v in starts:
            if g.alive[v] and v not in seen and v not in met:
                part = g.flood(v, max(1, k - 1), met)
                if part is not None:
                    spokes.append(part)
                    seen.update(part)
        for part in sorted(spokes, key=lambda p: (len(p), p)):
            near_end += part
            for v in part:
                g.remove(v)
        g.requeue()
    return SlashBurn(near_end + far_end[::-1], rounds, k)


def slashburn_order(members: DataFrame, intra: DataFrame, k: int | None = None) -> DataFrame:
    """(label, node, new_idx): the SlashBurn order of each community, one community a group."""
    nodes = members.select("label", F.col("node").alias("u"), F.col("node").alias("v"), F.lit(False).alias("edge"))

    def run(label: str, group: dict[str, list]) -> list[tuple]:
        us, vs, edge = group["u"], group["v"], group["edge"]
        ids = sorted(u for u, e in zip(us, edge) if not e)
        at = {x: i for i, x in enumerate(ids)}
        found = slashburn(len(ids), [(at[u], at[v]) for u, v, e in zip(us, vs, edge) if e], k)
        return [(label, ids[x], i) for i, x in enumerate(found.order)]

    arrow = pa.schema([("label", pa.string()), ("node", pa.int64()), ("new_idx", pa.int32())])
    both = nodes.unionByName(intra.select("label", "u", "v", F.lit(True).alias("edge")))
    return over_groups(both, "label", run, "label string, node long, new_idx int", arrow)


def compress(c: Column) -> Column:
    """Every dictionary entry replaced by its token, entry by entry. Not reversible in all cases; see ``compress_exact``."""
    for i, source in enumerate(DICTIONARY):
        c = F.replace(c, F.lit(source), F.lit(f"${i}$"))
    return c


def restore(c: Column) -> Column:
    """Every token replaced by its entry, token by token in the same order; loses what ``compress`` made ambiguous."""
    for i, source in enumerate(DICTIONARY):
        c = F.replace(c, F.lit(f"${i}$"), F.lit(source))
    return c


def compress_exact(c: Column) -> Column:
    """As ``compress``, with the token sign itself given a token first, so that nothing is lost."""
    return compress(F.replace(c, F.lit("$"), F.lit(f"${len(DICTIONARY)}$")))


def restore_exact(c: Column) -> Column:
    """The text of ``compress_exact``: between token signs, text and token numbers alternate from left to right."""
    words = F.array(*(F.lit(s) for s in (*DICTIONARY, "$")))
    parts = F.split(c, r"\$", -1)
    return F.when(
        c.isNotNull(), F.concat_ws("", F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.element_at(words, p.cast("int") + 1)).otherwise(p)))
    )


def reorder_matrix(matrix: DataFrame, order: DataFrame, rows: bool = True, columns: bool = True) -> DataFrame:
    """(i, j, v) with rows and/or columns renumbered by (old, new)."""
    out = matrix
    for on, name in ((rows, "i"), (columns, "j")):
        if on:
            out = out.join(order.withColumnsRenamed({"old": name, "new": "_new"}), name).drop(name).withColumnRenamed("_new", name)
    return out.select("i", "j", "v")


def reorder_vector(vector: DataFrame, order: DataFrame, reverse: bool = False) -> DataFrame:
    """(i, v) renumbered by (old, new), or back."""
    a, b = ("new", "old") if reverse else ("old", "new")
    return vector.join(order.withColumnsRenamed({a: "i", b: "_to"}), "i").select(F.col("_to").alias("i"), "v")


def partition_matrix(matrix: DataFrame, n: int, m: int | None = None) -> DataFrame:
    """(quadrant, i, j, v): the four parts of a matrix cut at row n and column m (n by default), each with its own indices."""
    m = n if m is None else m
    low, left = F.col("i") >= n, F.col("j") >= m
    return matrix.select(
        (F.when(low, 2).otherwise(0) + F.when(left, 1).otherwise(0)).alias("quadrant"),
        F.when(low, F.col("i") - n).otherwise(F.col("i")).alias("i"),
        F.when(left, F.col("j") - m).otherwise(F.col("j")).alias("j"),
        "v",
    )


def degree_rank(matrix: DataFrame, ascending: bool = True) -> DataFrame:
    """(old, new): columns of a matrix in order of how many entries they hold, ties by column."""
    degree = matrix.groupBy(F.col("j").alias("old")).agg(F.count(F.lit(1)).alias("deg"))
    signed = degree.withColumn("key", F.col("deg") if ascending else -F.col("deg"))
    return with_position(signed, "key", "old", name="new").select("old", "new")


def at_least(matrix: DataFrame, t: float) -> DataFrame:
    """The entries of magnitude ``t`` or more."""
    return matrix.where(F.abs("v") >= t)
