"""Texts of varying length into containers of fixed capacity: best-fit decreasing, in shards.

Within a shard, texts go longest first into the open container with the least room that still
takes them; a segment tree over the remaining capacities finds it in logarithmic time. Shards are
hash groups of bounded size, so no task sees the whole corpus; what a shard loses against one
global packing is at most its last, partly filled containers. Of a text beyond the capacity only
the remainder is packed; its other pieces fill their containers where they lie.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.tokens import VOCABULARY, with_tokens
from tracewright.session import cut

SHARD_ITEMS = 50_000
MAX_PROFILES = 100


class RoomTree:
    """Open containers by remaining room: a segment tree whose nodes count the containers below them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        # beyond what a text model's context asks for, only the nodes that are touched are kept
        self.count = [0] * (2 * self.leaves) if capacity <= 1 << 20 else defaultdict(int)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        self.bins.setdefault(room, []).append(container)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, container) of the tightest container with at least ``size`` room, removed; None if there is none."""
        count, i = self.count, size + self.leaves
        while not count[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
            if not i:
                return None
            i += 1
            if i == 1:
                return None
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        container = self.bins[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, numbered in order of opening; sizes run from 1 to ``capacity`` and descend."""
    tree, out, opened = RoomTree(capacity), [], 0
    for size in sizes:
        got = tree.take(size)
        if got is None:
            room, container = capacity, opened
            opened += 1
        else:
            room, container = got
        out.append(container)
        if room > size:
            tree.add(room - size, container)
    return out


def _pack_shard(key: tuple, items: pa.Table) -> pa.Table:
    capacity, shard = key[1].as_py(), key[2].as_py()
    items = items.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
    bins = best_fit_decreasing(items["n_tokens"].to_pylist(), capacity)
    items = items.append_column("container_id", pa.array([(shard << 32) + b for b in bins], pa.int64()))
    return items.select(["profile", "capacity_tokens", "container_id", "doc_id", "piece_no", "tok_start", "n_tokens"])


def pack(documents: DataFrame, profiles: DataFrame, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every document under every profile: profile, capacity_tokens, container_id, doc_id, piece_no, tok_start, n_tokens.

    A text of at most the capacity is one piece (piece_no 0). A longer one is cut into pieces of
    just the capacity and a remainder; only such texts are divided. A piece of just the capacity
    fills a container, whose id is negative, and needs no packing. A null or empty text, which has no
    tokens, is listed once per profile with a null container_id. The tokens of a container never
    exceed its capacity. Profiles with a null or non-positive capacity are left out. Copies are
    packed like any other text. Empty tables give an empty result.
    """
    return pack_sizes(cut(with_tokens(documents.select("doc_id", "text"), "text", vocabulary), "sizes"), profiles, shard_items)


def pack_sizes(sizes: DataFrame, profiles: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``pack`` of texts whose sizes (doc_id, n_tokens) are known.

    What is left to pack is at most one item a text, so shards of ``shard_items`` texts hold no more items, however long the texts.
    """
    found = profiles.where("profile is not null and capacity_tokens > 0").select("profile", "capacity_tokens").distinct().limit(MAX_PROFILES + 1).collect()
    if len(found) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} container profiles")
    shards = max(1, math.ceil(sizes.count() / shard_items))
    each = [F.struct(F.lit(r[0]).alias("profile"), F.lit(r[1]).cast("int").alias("capacity_tokens")) for r in sorted(found, key=tuple)]
    if not each:
        each = [F.lit(None).cast("struct<profile:string,capacity_tokens:int>")]
    cap = F.col("capacity_tokens").cast("long")
    per_profile = sizes.select("doc_id", "n_tokens", F.explode(F.array(*each)).alias("p")).where("p is not null").select("doc_id", F.col("n_tokens").alias("whole"), "p.*")
    per_profile = per_profile.withColumn("n_full", F.floor(F.col("whole") / cap)).withColumn("rest", F.col("whole") - F.col("n_full") * cap)
    columns = ["profile", "capacity_tokens", "container_id", "doc_id", "piece_no", "tok_start", "n_tokens"]
    full = (
        per_profile.where("n_full > 0")
        .select("profile", "capacity_tokens", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)).alias("piece_no"))
        .select("*", (-1 - F.monotonically_increasing_id()).alias("container_id"), (F.col("piece_no") * cap).alias("tok_start"), cap.alias("n_tokens"))
        .withColumn("piece_no", F.col("piece_no").cast("int"))
    )
    schema = "profile string, capacity_tokens int, container_id long, doc_id long, piece_no int, tok_start long, n_tokens long"
    items = per_profile.where("rest > 0").select(
        "profile", "capacity_tokens", "doc_id", F.col("n_full").cast("int").alias("piece_no"), (F.col("n_full") * cap).alias("tok_start"), F.col("rest").alias("n_tokens")
    )
    packed = items.groupBy("profile", "capacity_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")).applyInArrow(_pack_shard, schema)
    nothing = per_profile.where("whole = 0").select(
        "profile", "capacity_tokens", F.lit(None).cast("long").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("tok_start"), F.col("whole").alias("n_tokens")
    )
    return packed.unionByName(full.select(*columns)).unionByName(nothing)


def packing_audit(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per profile what must hold of a packing of distinct texts (doc_id, n_tokens): n_texts, and counts that must be 0.

    n_lost: texts whose pieces don't add up to their tokens; n_divided: texts in several pieces though
    they fit; n_apart: pieces that don't begin where the one before ends; n_overfull: containers
    beyond their capacity.
    """
    key = ["profile", "capacity_tokens"]
    before = F.sum("n_tokens").over(Window.partitionBy(*key, "doc_id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1))  # pieces of one text
    each = packed.withColumn("apart", (F.col("tok_start") != F.coalesce(before, F.lit(0))).cast("int"))
    texts = each.groupBy(*key, "doc_id").agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("pieces"), F.sum("apart").alias("apart"))
    of = texts.join(sizes, "doc_id").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.col("held") != F.col("n_tokens")).alias("n_lost"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("n_divided"),
        F.sum("apart").alias("n_apart"),
    )
    fill = packed.where("container_id is not null").groupBy(*key, "container_id").agg(F.sum("n_tokens").alias("n"))
    over = fill.groupBy(*key).agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"))
    return of.join(over, key, "left").fillna(0, ["n_overfull"])


def packing_report(packed: DataFrame) -> DataFrame:
    """Per profile: containers, tokens, items and the share of the containers' room that is filled."""
    return (
        packed.where("container_id is not null")
        .groupBy("profile", "capacity_tokens", "container_id")
        .agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
        .groupBy("profile", "capacity_tokens")
        .agg(
            F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.max("tokens").alias("fullest")
        )
        .withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )
