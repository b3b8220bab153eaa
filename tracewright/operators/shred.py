"""Deeply nested records to an adjacency table of nodes, and from it to flat related tables.

Each JSON record becomes nodes (node, parent, label, ordinal, kind, scalar, path). Object nodes
joined with their scalar children and pivoted on the label give one flat table per entity, whose
rows keep the ids of record and parent object; ``entity_rows`` has all objects in one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import deepjson

#: Members that wrap a value without naming it.
WRAPPERS = frozenset(("array", "map", "string", "int", "long", "bytes", "boolean"))
WRAPPER_PREFIX = "com.bbn.tc.schema.avro"

_INNER = ("object", "array", "wrapped_array")

NODE_SCHEMA = (
    "file_ord int, line_off long, rec_class string, cdm_version string, node_id int, parent_id int, object_id int, label string, ordinal int, "
    "kind string, scalar string, node_path string, in_array boolean"
)
_ARROW = pa.schema(
    [
        ("file_ord", pa.int32()), ("line_off", pa.int64()), ("rec_class", pa.string()), ("cdm_version", pa.string()), ("node_id", pa.int32()),
        ("parent_id", pa.int32()), ("object_id", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()),
        ("scalar", pa.string()), ("node_path", pa.string()), ("in_array", pa.bool_()),
    ]
)


def whole_json(text: str | None):
    """The parsed line, whatever its depth, or None where it is null, empty, cut off or otherwise not one JSON value."""
    if not text:
        return None
    try:
        return deepjson.loads(text)
    except ValueError:
        return None


def bodies(record) -> Iterator[tuple[str, str, object]]:
    """(class, CDM version, body) of each class name in a record's ``datum``."""
    datum = record.get("datum") if isinstance(record, dict) else None
    if isinstance(datum, dict):
        for name, body in datum.items():
            head, _, cls = name.rpartition(".")
            version = head.rpartition(".")[2]
            yield cls, version if version.startswith("cdm") else "", body


def unwrap(value):
    """The value inside any wrappers."""
    while isinstance(value, dict) and len(value) == 1:
        (name,) = value
        if name not in WRAPPERS and not name.startswith(WRAPPER_PREFIX):
            break
        value = value[name]
    return value


def _kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    return "array" if isinstance(value, list) else "number"


def _nodes(body, paths: bool) -> Iterator[tuple]:
    """Depth first, without recursion: (node, parent, nearest object, label, ordinal, kind, scalar, path, in_array)."""
    number = 0
    stack = [(body, -1, -1, "", -1, "", False)]
    push = stack.append
    while stack:
        raw, parent, owner, label, ordinal, path, element = stack.pop()
        is_object = isinstance(raw, dict)
        value = unwrap(raw) if is_object else raw
        kind = _kind(value)
        if kind == "object":
            text = None
            dot = path + "." if path else ""
            for k in reversed(value):
                v = value[k]
                push((v, number, number, k, -1, dot + k if paths or isinstance(v, (dict, list)) else None, False))
        elif kind == "array":
            text = None
            for i in range(len(value) - 1, -1, -1):
                push((value[i], number, owner, label, i, f"{path}[{i}]", True))
        else:
            text = value if kind == "string" or value is None else str(value) if type(value) is int else json.dumps(value)
        yield number, parent, owner, label, ordinal, ("wrapped_" + kind if element and is_object and kind != "object" else kind), text, path, element
        number += 1


_FLUSH = 50_000


def _shredder(paths: bool):
    def batch_of(heads: list[tuple], counts: list[int], rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(len(heads)), counts))
        cols = [pa.array(c, f.type).take(at) for c, f in zip(zip(*heads), _ARROW)]
        cols += [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_ARROW)[len(cols) :])]
        return pa.RecordBatch.from_arrays(cols, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads: list[tuple] = []
            counts: list[int] = []
            rows: list[tuple] = []
            for file_ord, line_off, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for cls, version, body in bodies(whole_json(text)):
                    heads.append((file_ord, line_off, cls, version))
                    counts.append(-len(rows))
                    for node in _nodes(body, paths):
                        rows.append(node)
                        if len(rows) == _FLUSH:  # a record of many nodes goes on in the next batch
                            counts[-1] += _FLUSH
                            yield batch_of(heads, counts, rows)
                            heads, counts, rows = heads[-1:], [0], []
                    counts[-1] += len(rows)
            if rows:
                yield batch_of(heads, counts, rows)

    return run


def shred(records: DataFrame, classes: tuple[str, ...] = (), paths: bool = True) -> DataFrame:
    """The adjacency table of all records: one row per node (``NODE_SCHEMA``).

    node_id counts the nodes of a record depth first from 0, the record body itself;
    parent_id is the node that holds it (-1 for the body), object_id the nearest object around it,
    label its field name, ordinal its array position (-1 outside arrays), kind what it is once its
    wrappers are taken off ('wrapped_...' for an array's element that is a wrapper object around
    something that is no object), scalar its value as text. Lines that aren't whole JSON, are null or have no class in
    datum give no row; a line sent twice gives its rows at both offsets. A repeated key keeps its
    last value. Other columns of ``records`` are ignored. With ``classes`` only lines that hold one of
    these words are parsed. ``paths=False`` leaves out the paths of scalars outside arrays.
    """
    if classes:
        named = F.col("value").contains("\\u")  # a class name may be written in escapes
        for c in classes:
            named |= F.col("value").contains(c)
        records = records.where(named)
    nodes = records.select(F.col("file_ord").cast("int"), F.col("line_off").cast("long"), "value").mapInArrow(_shredder(paths), NODE_SCHEMA)
    return nodes.where(F.col("rec_class").isin(*classes)) if classes else nodes


_KEYS = ["file_ord", "line_off", "rec_class", "cdm_version"]


def _object() -> Column:
    return (F.col("kind") == "object") | F.col("kind").startswith("wrapped_")


def _entities(nodes: DataFrame, columns: list[Column]) -> DataFrame:
    """Object nodes joined with their scalar children, which ``columns`` aggregate (of ``field``: label and scalar).

    An object's own row and its children's meet under the object's id in one exchange, combined
    before it, as the nodes of a record come from one task.
    """
    child = ~_object() & ~F.col("kind").isin(*_INNER) & ~F.col("in_array") & F.col("scalar").isNotNull()
    rows = nodes.where(_object() | child).select(
        *_KEYS,
        F.when(_object(), F.col("node_id")).otherwise(F.col("object_id")).alias("node_id"),
        F.when(_object(), F.struct(F.col("object_id").alias("parent_id"), "node_path", "in_array", "kind", "scalar")).alias("own"),
        F.when(child, F.struct("label", "scalar")).alias("field"),
    )
    return rows.groupBy(*_KEYS, "node_id").agg(F.max("own").alias("own"), *columns).where(F.col("own").isNotNull())


def entity_rows(nodes: DataFrame) -> DataFrame:
    """A row for every object of every class, at whatever place, with its scalar children.

    file_ord, line_off, node_id, parent_id, rec_class, place (node_path without positions), node_path, is_element, n_fields, fields.
    parent_id is the object around it, -1 for the body. fields is 'label=value' by line, in order of
    label, nulls left out. A wrapper that is an array's element is an object too, whatever it
    holds; its scalar is its one field, without a label. (file_ord, line_off) names a line: rows
    that repeat one count once.
    """
    lone = F.when(F.col("own.scalar").isNotNull(), F.array(F.struct(F.lit("").alias("label"), F.col("own.scalar").alias("scalar"))))
    of = F.array_sort(F.coalesce(lone, F.col("of")))
    found = _entities(nodes, [F.collect_set("field").alias("of")]).withColumn("of", of)
    return found.select(
        "file_ord", "line_off", "node_id", "own.parent_id", "rec_class", F.regexp_replace("own.node_path", r"\[[0-9]+\]", "[]").alias("place"),
        "own.node_path", F.col("own.in_array").alias("is_element"), F.size("of").cast("long").alias("n_fields"),
        F.array_join(F.transform("of", lambda x: F.concat(x["label"], F.lit("="), x["scalar"])), "\n").alias("fields"),
    )


def array_objects(records: DataFrame) -> DataFrame:
    """(file_ord, line_off, node_path) of each JSON object that is an element of an array: those of ``entity_rows``."""
    return entity_rows(shred(records, paths=False)).where("is_element").select("file_ord", "line_off", "node_path")


def flat_table(nodes: DataFrame, rec_class: str, at: str, fields: dict[str, str]) -> DataFrame:
    """One flat table: the objects of one class at one place, a column per field.

    ``at`` is a pattern (a whole-string regular expression) for node_path, '' for the record body
    itself; ``fields`` maps output columns to labels of scalar children. Each row has file_ord,
    line_off (the record), node_id (the object) and parent_id (the object around it, -1 for the
    body). A field that is absent or null is null; without ``fields`` only the ids come out.
    """
    wanted = (F.col("kind") == "object") & F.col("node_path").rlike(f"^(?:{at})$") | ~_object() & F.col("label").isin(*fields.values())
    columns = [F.max(F.when(F.col("field.label") == label, F.col("field.scalar"))).alias(name) for name, label in fields.items()]
    found = _entities(nodes.where((F.col("rec_class") == rec_class) & wanted), columns)
    return found.select("file_ord", "line_off", "node_id", "own.parent_id", *fields)


def element_table(nodes: DataFrame, rec_class: str, at: str) -> DataFrame:
    """The scalar array elements of one class whose node_path matches ``at``: file_ord, line_off, node_id, parent_id, position, value.

    parent_id is the object around the array. A null element has a row with a null value.
    """
    own = nodes.where((F.col("rec_class") == rec_class) & F.col("in_array") & F.col("node_path").rlike(f"^(?:{at})$"))
    return own.where(~F.col("kind").isin(*_INNER)).select(
        "file_ord", "line_off", "node_id", F.col("object_id").alias("parent_id"), F.col("ordinal").alias("position"), F.col("scalar").alias("value")
    )


def coverage(nodes: DataFrame, tables: list[tuple[str, str, dict[str, str]]], elements: list[tuple[str, str]]) -> DataFrame:
    """What flat tables leave out, by class and place: objects, and values (scalars that aren't null) of objects and of arrays.

    rec_class, place, n_objects, n_objects_missing, n_values, n_values_missing. ``tables`` are (class, pattern, fields) of
    ``flat_table``, ``elements`` (class, pattern) of ``element_table``; a value in an object counts at the object's place, one in an array at its own.
    """

    def within(at: str) -> Column:
        return F.col("node_path").rlike(f"^(?:{at})$")

    held = named = listed = F.lit(False)
    for cls, at, fields in tables:
        here = (F.col("rec_class") == cls) & within(at)
        held, named = held | here & (F.col("kind") == "object"), named | here & F.col("label").isin(*fields.values())
    for cls, at in elements:
        listed = listed | (F.col("rec_class") == cls) & within(at)
    is_object = F.col("kind").isin("object", "wrapped_array")
    value = ~F.col("kind").isin(*_INNER) & F.col("scalar").isNotNull()
    around = F.expr("left(node_path, greatest(0, length(node_path) - length(label) - 1))")
    of = nodes.where(is_object | value).withColumn("node_path", F.when(value & ~F.col("in_array"), around).otherwise(F.col("node_path")))
    return of.groupBy("rec_class", F.regexp_replace("node_path", r"\[[0-9]+\]", "[]").alias("place")).agg(
        F.count_if(is_object).alias("n_objects"),
        F.count_if(is_object & ~held).alias("n_objects_missing"),
        F.count_if(value).alias("n_values"),
        F.count_if(value & ~F.when(F.col("in_array"), listed).otherwise(named)).alias("n_values_missing"),
    )


def scalar_table(nodes: DataFrame) -> DataFrame:
    """Every scalar, array elements included, at whatever place: file_ord, line_off, node_id, parent_id, rec_class, label, position, kind, value, node_path.

    parent_id is the object around it, position -1 outside arrays. Nulls have a row with a null value.
    """
    return nodes.where(~F.col("kind").isin(*_INNER)).select(
        "file_ord", "line_off", "node_id", F.col("object_id").alias("parent_id"), "rec_class", "label",
        F.col("ordinal").alias("position"), F.regexp_replace("kind", "^wrapped_", "").alias("kind"), F.col("scalar").alias("value"), "node_path",
    )
