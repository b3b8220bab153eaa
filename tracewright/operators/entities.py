"""Entities of a log: class precedence, dense ids, and the resolution of events and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import extract
from tracewright.operators.ordering import with_position
from tracewright.sources.profiles import Profile

#: The classes in order of precedence.
CLASSES = ("subject", "file", "socket", "other")


def used_uuids(events: DataFrame) -> DataFrame:
    """(uuid): both ends of all events."""
    return events.select(F.explode(F.array("src_uuid", "dst_uuid")).alias("uuid")).where("uuid is not null").distinct()


def known_entities(records: DataFrame, p: Profile, precedence: tuple[str, ...] = CLASSES[:3]) -> DataFrame:
    """(uuid, cls_rank, attr, first_at): one row per uuid, the class of highest precedence."""
    of = {"subject": extract.subjects, "file": extract.files, "socket": extract.sockets}
    parts = [of[cls](records, p).select("uuid", F.lit(rank).alias("cls_rank"), "attr", "first_at") for rank, cls in enumerate(precedence)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = F.min_by(F.struct("attr", "first_at"), "cls_rank")
    return every.groupBy("uuid").agg(F.min("cls_rank").alias("cls_rank"), best.alias("b")).select("uuid", "cls_rank", "b.attr", "b.first_at")


def entity_table(records: DataFrame, p: Profile, precedence: tuple[str, ...] = CLASSES[:3]) -> DataFrame:
    """(entity_id, uuid, cls, attr) of every uuid that takes part in a considered event.

    A uuid that records of several classes name is of the first of them in ``precedence``. Ids are dense from 0 by class precedence, then first appearance, then uuid; an end without
    any record of its own is of class other.
    """
    used = used_uuids(extract.event_tuples(records, p))
    known = known_entities(records, p, precedence).join(used, "uuid", "left_semi")
    rest = used.join(known, "uuid", "left_anti").select(
        "uuid", F.lit(3).alias("cls_rank"), F.lit("other").alias("attr"), F.lit(None).cast("struct<file_ord:int,line_off:bigint>").alias("first_at")
    )
    placed = with_position(known.unionByName(rest), "cls_rank", "first_at", "uuid", name="entity_id")
    names = F.array(*map(F.lit, (*precedence, CLASSES[3])))
    return placed.select("entity_id", "uuid", F.element_at(names, F.col("cls_rank") + 1).alias("cls"), "attr")


def dense_ids(entities: DataFrame) -> DataFrame:
    """(uuid, cls, new_id): dense ids of an entity table, one per uuid, by class precedence, smallest entity_id, uuid."""
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.coalesce("cls", F.lit("other")))
    one = (
        entities.where("uuid is not null")
        .select("uuid", F.struct(F.when(rank > 0, rank).otherwise(5).alias("r"), "entity_id", "cls").alias("k"))
        .groupBy("uuid")
        .agg(F.min("k").alias("k"))
        .select("uuid", F.col("k.r").alias("r"), F.col("k.entity_id").alias("entity_id"), F.col("k.cls").alias("cls"))
    )
    return with_position(one, "r", "entity_id", "uuid", name="new_id").select("uuid", "cls", "new_id")


def resolve_events(records: DataFrame, p: Profile, strict: bool = False) -> DataFrame:
    """(file_ord, line_off, src, etype, dst, ts_ns): events with the ids of both ends.

    ``strict`` keeps only events whose source is a known subject and whose object is a known
    file, socket or subject.
    """
    ids = entity_table(records, p)
    from_ids = ids.where(F.col("cls") == "subject") if strict else ids
    to_ids = ids.where(F.col("cls") != "other") if strict else ids
    return (
        extract.event_tuples(records, p)
        .join(from_ids.select(F.col("uuid").alias("src_uuid"), F.col("entity_id").alias("src")), "src_uuid")
        .join(to_ids.select(F.col("uuid").alias("dst_uuid"), F.col("entity_id").alias("dst")), "dst_uuid")
        .select("file_ord", "line_off", "src", "etype", "dst", "ts_ns")
    )


def ground_truth(listed: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched (entity_id, uuid), missed (uuid)) of a list of uuids; repeated rows count once, null is no uuid."""
    want = listed.where("uuid is not null").select("uuid").distinct()
    have = entities.where("uuid is not null").groupBy("uuid").agg(F.min("entity_id").alias("entity_id"))
    return want.join(have, "uuid").select("entity_id", "uuid"), want.join(have, "uuid", "left_anti")
