"""Raw audit lines to events and entities, by pattern, for every log family of ``PROFILES``.

A line's class is the first of Event, Subject, FileObject and NetFlowObject whose token it holds;
a field is the first match on the line. All of it is built-in string functions over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.sources import profiles as fields
from tracewright.sources.profiles import Profile


def first_match(pattern: str, group: int = 1) -> Column:
    """The group of a pattern's first match on the line, null without one; an empty group is ''."""
    return F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, group))


def classified(records: DataFrame, p: Profile) -> DataFrame:
    """(file_ord, line_off, value, rec_kind) of the lines that hold a class token of the profile's version."""
    kind = F
    for cls in ("Event", "Subject", "FileObject", "NetFlowObject"):
        kind = kind.when(F.col("value").contains(f'{p.version}.{cls}"'), cls)
    return records.select("file_ord", "line_off", "value", kind.alias("rec_kind")).where("rec_kind is not null")


def _own(cls: str, p: Profile) -> str:
    return fields.OWN_UUID.format(v=p.version, c=cls)


def _ref(name: str, p: Profile) -> str:
    return fields.REFERENCE.format(v=p.version, f=name)


def event_tuples(records: DataFrame, p: Profile) -> DataFrame:
    """(file_ord, line_off, src_uuid, etype, dst_uuid, ts_ns, path, exec): considered events with both ends.

    ts_ns is 0 where the line has no timestamp followed by a comma, or one that isn't a number. path
    and exec (the first that follows the subject) are null where absent.
    """
    lines = classified(records, p).where(F.col("rec_kind") == "Event")
    if p.drop_flows:
        lines = lines.where(~F.col("value").contains("EVENT_FLOWS_TO"))
    found = lines.select(
        "file_ord",
        "line_off",
        first_match(_ref("subject", p)).alias("src_uuid"),
        first_match(fields.EVENT_TYPE).alias("etype"),
        first_match(_ref("predicateObject", p)).alias("dst_uuid"),
        F.coalesce(first_match(fields.EVENT_TIME).try_cast("long"), F.lit(0)).alias("ts_ns"),
        first_match(fields.EVENT_PATH).alias("path"),
        first_match(_ref("subject", p) + fields.EVENT_EXEC, 2).alias("exec"),
    )
    return found.where(F.col("etype").isin(*p.types) & F.col("src_uuid").isNotNull() & F.col("dst_uuid").isNotNull())


def _at() -> Column:
    return F.struct("file_ord", "line_off").alias("at")


def _last(attr: str, missing: str) -> Column:
    """The attribute of the last record that has one, else the stand-in."""
    return F.coalesce(F.max_by(attr, F.when(F.col(attr).isNotNull(), F.col("at"))), F.lit(missing)).alias("attr")


def _members(records: DataFrame, p: Profile, cls: str, attr: Column) -> DataFrame:
    lines = classified(records, p).where(F.col("rec_kind") == cls)
    return lines.select(first_match(_own(cls, p)).alias("uuid"), _at(), attr.alias("name")).where("uuid is not null")


def _named(rows: DataFrame, p: Profile) -> DataFrame:
    """Rows with a name that counts as one."""
    rows = rows.where("name is not null")
    return rows.where("name <> ''") if p.skip_empty else rows


def subjects(records: DataFrame, p: Profile) -> DataFrame:
    """(uuid, attr, first_at) of the subjects; a repeated subject keeps the attribute of its last record."""
    if p.subject_rule == "exec_any":
        lines = records.where(F.col("value").contains("Event"))
        pair = _ref("subject", p) + fields.EVENT_EXEC
        rows = _named(lines.select(first_match(pair).alias("uuid"), _at(), first_match(pair, 2).alias("name")), p)
    else:
        rule = {"cmdLine": fields.COMMAND_LINE, "path": fields.PLAIN_FIELD.format(f="path")}.get(p.subject_rule)
        rows = _members(records, p, "Subject", first_match(rule) if rule else F.lit(None).cast("string"))
        if p.subject_rule == "exec":  # names come from events of known subjects
            acted = event_tuples(records, p).where("exec is not null")
            last = acted.groupBy(F.col("src_uuid").alias("uuid")).agg(F.max_by("exec", _at()).alias("name"))
            rows = rows.drop("name").join(last, "uuid", "left")
        elif p.strict:
            rows = _named(rows, p)
    if not p.long_uuids:
        rows = rows.where(F.length("uuid") != 64)
    attr = F.max_by(F.coalesce("name", F.lit(p.missing[0])), "at").alias("attr")  # the last record wins, with or without an attribute
    return rows.groupBy("uuid").agg(attr, F.min("at").alias("first_at"))


def files(records: DataFrame, p: Profile) -> DataFrame:
    """(uuid, attr, first_at) of the files, under the profile's rule for which name wins."""
    if p.file_rule in ("filename", "path"):
        rows = _members(records, p, "FileObject", first_match(fields.PLAIN_FIELD.format(f=p.file_rule)))
        rows = rows.where("name is not null") if p.strict else rows
        found = rows.groupBy("uuid").agg(_last("name", p.missing[1]), F.min("at").alias("first_at"))
        return found.where(~F.col("attr").isin(*p.unnamed)) if p.unnamed else found
    own = _members(records, p, "FileObject", F.lit(p.missing[1]))
    if p.file_rule == "event_any":
        lines = classified(records, p).where(F.col("rec_kind") == "Event")
        lines = lines.where(~F.col("value").contains('"predicateObjectPath":null,') & ~F.col("value").contains("<unknown>"))
        path = F.coalesce(first_match(fields.EVENT_PATH), F.lit(p.missing[1]))
        seen = lines.select(first_match(_ref("predicateObject", p)).alias("uuid"), _at(), path.alias("name"))
        found = seen.join(own.select("uuid").distinct(), "uuid", "left_semi").groupBy("uuid")
        return found.agg(F.max_by("name", "at").alias("attr"), F.min("at").alias("first_at")).where(~F.col("attr").isin(*p.unnamed))
    seen = event_tuples(records, p).where("path is not null").select(F.col("dst_uuid").alias("uuid"), _at(), F.col("path").alias("name"))
    if p.file_rule == "event_first":  # first writer wins, a file record writes the stand-in
        return own.unionByName(seen).groupBy("uuid").agg(F.min_by("name", "at").alias("attr"), F.min("at").alias("first_at"))
    named = seen.groupBy("uuid").agg(F.max_by("name", "at").alias("name"))
    first = own.groupBy("uuid").agg(F.min("at").alias("first_at"))
    return first.join(named, "uuid", "left").select("uuid", F.coalesce("name", F.lit(p.missing[1])).alias("attr"), "first_at")


def sockets(records: DataFrame, p: Profile) -> DataFrame:
    """(uuid, attr, first_at): 'local address,port,remote address,port'; the last well-formed record wins, one id per uuid."""
    whole = fields.SOCKET + fields.ADDRESSES[p.version]
    name = F.when(F.col("value").rlike(whole), F.concat_ws(",", *(F.regexp_extract("value", whole, i) for i in range(1, 5))))
    rows = _members(records, p, "NetFlowObject", name)
    return rows.groupBy("uuid").agg(_last("name", p.missing[2]), F.min("at").alias("first_at"))
