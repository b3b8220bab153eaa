"""Record schemas that drift from file to file: one consistent table, and a report of every change.

Ingestion holds each record against a target schema. What fits goes into typed columns; a field
the schema doesn't know, or whose value can't be cast, is kept as JSON in the rescue column.
Fields approved later are promoted: their rescued values are replayed into typed columns. The
report is read off an ingestion that casts nothing but what fits exactly: which fields each file
has in typed columns and in the rescue column, and, only where fields came and went, their typed
and rescued values joined by uuid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import deepjson
from tracewright.operators.shred import bodies, unwrap, whole_json
from tracewright.session import cut

CLASSES = ("Subject", "FileObject", "NetFlowObject", "Event")
_VERSION = re.compile(r"cdm\d+", re.I)
_DIGITS = re.compile(r"([+-]?)0*([0-9]{1,19})")  # without leading zeros, an int64 has 19 digits at most

#: The approved schema of each class, field to type.
TARGETS: dict[str, dict[str, str]] = {
    "Subject": {"type": "string", "cid": "long", "parentSubject": "string", "localPrincipal": "string", "startTimestampNanos": "long", "cmdLine": "string"},
    "FileObject": {"type": "string", "filename": "string", "fileDescriptor": "long", "size": "long", "inode": "long"},
    "NetFlowObject": {"localAddress": "string", "localPort": "long", "remoteAddress": "string", "remotePort": "long", "ipProtocol": "long", "initTcpSeqNum": "long"},
    "Event": {"type": "string", "sequence": "long", "threadId": "long", "subject": "string", "predicateObject": "string", "timestampNanos": "long", "size": "long", "exec": "string", "name": "string", "predicateObjectPath": "string"},
}
#: Approved renames, typed column to the names its values also come under. Each is one that the report has shown: a name that
#: stands beside another with other values (pathHint, tgid, execPath) is none.
PROMOTED: dict[str, dict[str, tuple[str, ...]]] = {
    "Subject": {"cmdLine": ("cmdline", "commandLine", "cmd"), "localPrincipal": ("principal",), "cid": ("processId", "pid"), "startTimestampNanos": ("startNanos",)},
    "FileObject": {"filename": ("fileName", "path", "objectPath"), "fileDescriptor": ("fd",), "inode": ("inodeNo",)},
    "NetFlowObject": {"localAddress": ("srcAddress", "local_address"), "localPort": ("srcPort",), "remoteAddress": ("dstAddress", "remote_address"), "remotePort": ("dstPort",), "initTcpSeqNum": ("tcpSeq",)},
    "Event": {"exec": ("execName", "exe", "image"), "sequence": ("seqNo",), "name": ("syscall",), "predicateObjectPath": ("objectPath",)},
}
#: Approved lists and objects, kept as JSON text; column to the names its values also come under.
NESTED: dict[str, dict[str, tuple[str, ...]]] = {"FileObject": {"hashes": ("digests",)}}


def kind_of(value) -> str | None:
    """The kind of a field's value; None for null. Objects of a single member carry its name without package."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        return "array"
    if isinstance(value, dict):
        if len(value) == 1:
            return "object:" + next(iter(value)).rpartition(".")[2]
        return "object"
    return "number"


def _no_version(name: str) -> str:
    return _VERSION.sub("cdm", name)


def canonical(value) -> str:
    """JSON text under which equal values are equal, the CDM version inside names left out."""
    return deepjson.dumps(value, sort_keys=True, compact=False, name=_no_version)


def _text(value) -> str | None:
    """JSON text of a value without its wrappers; None for null."""
    value = unwrap(value)
    return None if value is None else deepjson.dumps(value)


def _cast(value, kind: str):
    """(fits, value) of an unwrapped value under a target type; 'json' takes anything as it came."""
    if kind == "json":
        return True, value
    value = unwrap(value)
    if value is None:
        return True, None
    if kind == "string":
        return isinstance(value, str), value
    if isinstance(value, bool):
        return False, None
    if isinstance(value, str) and (digits := _DIGITS.fullmatch(value)):
        value = int(digits[1] + digits[2])
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return True, value
    return False, None


#: Wrappers that ``_exactly`` takes off: their name is the kind, so that kind and value give the field back as it came.
_PLAIN = frozenset(("string", "int", "long"))


def _exactly(value, kind: str):
    """As ``_cast``, but only what the typed value and its kind tell in full; neither digits in a string nor anything wrapped twice."""
    if isinstance(value, dict):
        if len(value) != 1 or (inner := next(iter(value.items())))[0] not in _PLAIN or inner[1] is None:
            return False, None
        value = inner[1]
    if value is None:
        return True, None
    if kind == "string":
        return isinstance(value, str), value
    return kind == "long" and isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63, value


def rescue(body: dict, target: dict[str, str], exact: bool = False) -> tuple[dict, dict]:
    """(typed values, rescued fields) of one record body held against a target schema."""
    typed, rescued = {}, {}
    for name, value in body.items():
        if name == "uuid":
            continue
        if name in target:
            fits, got = (_exactly if exact else _cast)(value, target[name])
            if fits:
                typed[name] = got
                continue
        rescued[name] = value
    return typed, rescued


def _records(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, str, dict]]:
    for file_ord, line_off, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
        for cls, version, body in bodies(whole_json(text)):
            if isinstance(body, dict):
                yield file_ord, line_off, cls, version, body


def _uuid(body: dict) -> str | None:
    u = unwrap(body.get("uuid"))
    return u if isinstance(u, str) else None


def _lines(records: DataFrame) -> DataFrame:
    return records.select(F.col("file_ord").cast("int"), F.col("line_off").cast("long"), "value")


@lru_cache(maxsize=10_000)
def _kinds_text(kinds: tuple[tuple[str, str | None], ...]) -> str:
    return deepjson.dumps(dict(kinds), sort_keys=True)


@lru_cache(maxsize=10_000)
def _kinds_of(text: str) -> dict[str, str | None]:
    return deepjson.loads(text)


_TYPES = {"string": pa.string(), "long": pa.int64(), "json": pa.string()}


def _ingest(records: DataFrame, targets: dict[str, dict[str, str]], exact: bool = False) -> DataFrame:
    """Records of the classes of ``targets`` in one pass: file_ord, line_off, rec_class, cdm_version, uuid, the typed columns, _rescued, _kinds.

    A typed column serves all classes whose schema has it. _kinds: the fields of the record and the
    kinds they came in, a JSON object by name.
    """
    columns = {n: k for target in targets.values() for n, k in target.items()}
    texts = {n for n, k in columns.items() if k == "json"}
    schema = pa.schema(
        [("file_ord", pa.int32()), ("line_off", pa.int64()), ("rec_class", pa.string()), ("cdm_version", pa.string()), ("uuid", pa.string())]
        + [(n, _TYPES[k]) for n, k in columns.items()]
        + [("_rescued", pa.string()), ("_kinds", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_ord, line_off, cls, version, body in _records(batch):
                if cls in targets:
                    typed, rescued = rescue(body, targets[cls], exact)
                    typed |= {n: _text(typed[n]) for n in texts if n in typed}
                    rest = deepjson.dumps(rescued) if rescued else None
                    kinds = _kinds_text(tuple((n, kind_of(v)) for n, v in body.items() if n != "uuid")) if exact else None
                    rows.append((file_ord, line_off, cls, version, _uuid(body), *(typed.get(n) for n in columns), rest, kinds))
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    named = F.col("value").contains("\\u")  # a class name may be written in escapes
    for cls in targets:
        named |= F.col("value").contains(cls)
    fields = ", ".join(f"`{n}` {'string' if k == 'json' else k}" for n, k in columns.items())
    return _lines(records.where(named)).mapInArrow(
        run, f"file_ord int, line_off long, rec_class string, cdm_version string, uuid string, {fields}, _rescued string, _kinds string"
    )


def ingest(records: DataFrame, rec_class: str, target: dict[str, str] | None = None) -> DataFrame:
    """All records of one class under its target schema: file_ord, line_off, cdm_version, uuid, the typed columns, _rescued.

    _rescued is a JSON object of the fields that the schema doesn't have or whose value can't be
    cast, as they came; null where there are none. Wrappers are taken off before the cast. Lines
    that aren't whole JSON, or are null, give no row; a line sent twice gives two. Columns of type
    'json' hold the text of whatever value came.
    """
    return _ingest(records, {rec_class: TARGETS[rec_class] if target is None else target}).drop("rec_class", "_kinds")


def promote(table: DataFrame, approved: dict[str, tuple[str, ...]], texts: tuple[str, ...] = ()) -> DataFrame:
    """Replay rescued values of approved names into their typed columns, and take them out of _rescued.

    A typed value that is there stays; otherwise the first of the names, in the order given, whose
    value can be cast. Values that aren't taken stay rescued. ``texts`` are the columns of type 'json'.
    """
    kinds = {n: {"bigint": "long"}.get(k, k) for n, k in table.dtypes} | dict.fromkeys(texts, "json")
    names = table.columns
    at = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            wanted = {n: cols[at[n]].to_pylist() for n in approved}
            rest = cols[at["_rescued"]].to_pylist()
            for row, text in enumerate(rest):
                fields = deepjson.loads(text) if text else {}
                before = len(fields)
                for column, others in approved.items():
                    for name in others:
                        if wanted[column][row] is None and name in fields:
                            fits, got = _cast(fields[name], kinds[column])
                            got = _text(got) if kinds[column] == "json" else got
                            if fits and got is not None:
                                wanted[column][row] = got
                                del fields[name]
                if len(fields) < before:
                    rest[row] = deepjson.dumps(fields) if fields else None
            for n, values in (*wanted.items(), ("_rescued", rest)):
                cols[at[n]] = pa.array(values, cols[at[n]].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return table.mapInArrow(run, table.schema)


def with_found(approved: dict[str, tuple[str, ...]], columns: list[str], found: list[tuple[str, str]]) -> dict[str, tuple[str, ...]]:
    """The approved names and those that found (old, new) renames lead to from a column, over any number of renames.

    A name that already is a column's, or a column, stays where it is; one that leads to several columns is left out.
    """
    home = {c: c for c in columns} | {name: c for c, names in approved.items() for name in names}
    unclear: set[str] = set()
    out = {c: list(approved.get(c, ())) for c in columns}
    while True:
        near: dict[str, set[str]] = {}
        for pair in found:
            for known, name in (pair, pair[::-1]):
                if known in home and name not in home and name not in unclear:
                    near.setdefault(name, set()).add(home[known])
        if not near:
            return {c: tuple(names) for c, names in out.items() if names}
        for name, homes in sorted(near.items()):
            if len(homes) == 1:
                (home[name],) = homes
                out[home[name]].append(name)
            else:
                unclear.add(name)


def consistent_table(records: DataFrame, rec_class: str, files: DataFrame | None = None) -> DataFrame:
    """All records of a class in one table: ingestion under its approved schema, then the approved renames.

    With ``files`` (raw_files) also the renames that ``schema_changes`` finds between these files,
    as far as they lead to one of the columns; their pairs of names, not their records, pass the driver.
    """
    nested = NESTED.get(rec_class, {})
    target = TARGETS[rec_class] | dict.fromkeys(nested, "json")
    approved = PROMOTED[rec_class] | nested
    if files is not None:
        pairs = _compare(records, files)[3].where(F.col("rec_class") == rec_class).select("old_name", "new_name").distinct().collect()
        approved = with_found(approved, list(target), [tuple(p) for p in pairs])
    return promote(ingest(records, rec_class, target), approved, tuple(nested))


def field_inventory(ingested: DataFrame) -> DataFrame:
    """(file_ord, rec_class, field_name, kinds): the fields that an ingestion found in each file and class, typed or rescued, and the kinds of their non-null values.

    uuid is no field. Records of the same fields in the same kinds are counted once before
    anything travels, and the kinds of a field are a handful.
    """
    shapes = ingested.select("file_ord", "rec_class", "_kinds").distinct()
    found = shapes.select("file_ord", "rec_class", F.explode(F.from_json("_kinds", "map<string,string>")).alias("field_name", "kind"))
    return found.groupBy("file_ord", "rec_class", "field_name").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def _as_it_came(kind: str, value):
    """A field's value from its typed column and its kind."""
    return {kind.partition(":")[2]: value} if kind.startswith("object:") else value


def _values(ingested: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_ord, rec_class, field_name, uuid, value) of the non-null values of the wanted (file_ord, rec_class, field_name), from typed columns and the rescue column."""
    per_file = cut(wanted.groupBy("file_ord", "rec_class").agg(F.collect_set("field_name").alias("fields")), "wanted")
    schema = pa.schema([("file_ord", pa.int32()), ("rec_class", pa.string()), ("field_name", pa.string()), ("uuid", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, typed = [], {}
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = [at[n].to_pylist() for n in ("file_ord", "rec_class", "uuid", "fields", "_rescued", "_kinds")]
            for i, (file_ord, cls, uuid, names, rest, kinds) in enumerate(zip(*keys)):
                rest, kinds = deepjson.loads(rest) if rest else {}, _kinds_of(kinds)
                for n in names:
                    if kinds.get(n) is None:
                        continue
                    if n not in rest and n not in typed:
                        typed[n] = at[n].to_pylist()
                    rows.append((file_ord, cls, n, uuid, canonical(rest[n] if n in rest else _as_it_came(kinds[n], typed[n][i]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    asked = ingested.where(F.col("uuid").isNotNull()).drop("line_off", "cdm_version").join(per_file, ["file_ord", "rec_class"])
    return asked.mapInArrow(run, "file_ord int, rec_class string, field_name string, uuid string, value string")


def file_pairs(files: DataFrame) -> DataFrame:
    """(prev_ord, file_ord) of neighbouring files of a stream; one row per file, so the window is over metadata only."""
    w = Window.partitionBy("stream_name").orderBy("file_no", "file_ord")
    rows = files.where(F.col("file_ord").isNotNull() & F.col("stream_name").isNotNull()).select("file_ord", "stream_name", "file_no").distinct()
    return rows.select(F.lag("file_ord").over(w).alias("prev_ord"), F.col("file_ord").cast("int")).where(F.col("prev_ord").isNotNull())


_GROUP = ["prev_ord", "file_ord", "rec_class"]


def _compare(records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fields of neighbouring files: all, those that went, those that came, and (old_name, new_name) of the renamed."""
    pairs = cut(file_pairs(files), "pairs")
    ingested = cut(_ingest(records, TARGETS, exact=True), "ingested")
    fields = cut(field_inventory(ingested), "fields")
    before = pairs.join(fields.withColumnRenamed("file_ord", "prev_ord"), "prev_ord").withColumnRenamed("kinds", "old_kinds")
    after = pairs.join(fields, "file_ord").withColumnRenamed("kinds", "new_kinds")
    key = ["prev_ord", "file_ord", "rec_class", "field_name"]
    both = cut(before.join(after, key, "full"), "changes")
    gone, come = both.where(F.col("new_kinds").isNull()), both.where(F.col("old_kinds").isNull())
    maybe = cut(
        gone.select(*_GROUP, F.col("field_name").alias("old_name")).join(come.select(*_GROUP, F.col("field_name").alias("new_name")), _GROUP), "maybe"
    )
    wanted = maybe.select(F.col("prev_ord").alias("file_ord"), "rec_class", F.col("old_name").alias("field_name")).unionByName(
        maybe.select("file_ord", "rec_class", F.col("new_name").alias("field_name"))
    )
    digest = F.struct(  # of the set of values of one uuid, however many these are
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("value")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "value")).alias("y"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    values = _values(ingested, wanted.distinct()).distinct().groupBy("file_ord", "rec_class", "field_name", "uuid").agg(digest.alias("value"))
    values = cut(values, "values")
    old = maybe.join(
        values.select(F.col("file_ord").alias("prev_ord"), "rec_class", F.col("field_name").alias("old_name"), "uuid", F.col("value").alias("was")),
        ["prev_ord", "rec_class", "old_name"],
    )
    new = values.select("file_ord", "rec_class", F.col("field_name").alias("new_name"), "uuid", F.col("value").alias("now"))
    renamed = cut(
        old.join(new, ["file_ord", "rec_class", "new_name", "uuid"])
        .groupBy(*_GROUP, "old_name", "new_name")
        .agg(F.bool_and(F.col("was") == F.col("now")).alias("same"))
        .where("same"),
        "renamed",
    )
    return both, gone, come, renamed


def schema_changes(records: DataFrame, files: DataFrame) -> DataFrame:
    """Every change of fields from a file to the next: (file_ord, rec_class, field_name, change_kind).

    change_kind 'renamed' (field_name 'old>new'), 'removed', 'added' or 'retyped'. A pair of a
    field that went and one that came is a rename if in all uuids with non-null values of both, at
    least one, the values are equal (as sets, where a uuid has several). A field whose values are
    all null in either file isn't retyped. A class without any record in one of the two files
    has no fields there. Lines that aren't whole JSON take no part.
    """
    both, gone, come, renamed = _compare(records, files)
    retyped = both.where((F.size("old_kinds") > 0) & (F.size("new_kinds") > 0) & (F.col("old_kinds") != F.col("new_kinds")))

    def left_over(side: DataFrame, name: str, kind: str) -> DataFrame:
        taken = renamed.select(*_GROUP, F.col(name).alias("field_name")).distinct()
        return side.join(taken, [*_GROUP, "field_name"], "left_anti").select("file_ord", "rec_class", "field_name", F.lit(kind).alias("change_kind"))

    return (
        retyped.select("file_ord", "rec_class", "field_name", F.lit("retyped").alias("change_kind"))
        .unionByName(
            renamed.select("file_ord", "rec_class", F.concat_ws(">", "old_name", "new_name").alias("field_name"), F.lit("renamed").alias("change_kind"))
        )
        .unionByName(left_over(gone, "old_name", "removed"))
        .unionByName(left_over(come, "new_name", "added"))
    )
