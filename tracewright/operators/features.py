"""One row of features per entity over a catalogue of event types.

Scan side, blocks of events are encoded to (entity, type) indices and reduced with bincount and
scatters before anything travels, so an entity with a third of all events sends at most one row
per type and block. Entities are hash bucketed; each bucket's partial rows are scattered into
dense entity x type blocks of bounded size and leave as Arrow feature columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TYPES = 4096
BLOCK_ROWS = 400_000
BLOCK_ENTITIES = 2048
_PARTIAL = pa.schema([("entity_id", pa.int64()), ("code", pa.int32()), ("n", pa.int64()), ("last", pa.int64()), ("bytes", pa.int64())])


def catalogue(types: DataFrame) -> list[str]:
    """The event types in order. A catalogue is fixed in size; above ``MAX_TYPES`` it is refused."""
    names = [r[0] for r in types.where(F.col("etype").isNotNull()).select("etype").distinct().limit(MAX_TYPES + 1).collect()]
    if len(names) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    return sorted(names)


def _reduce(entity: np.ndarray, code: np.ndarray, n: np.ndarray | None, last: np.ndarray, size: np.ndarray, width: int):
    ids, row = np.unique(entity, return_inverse=True)
    cell, at = np.unique(row * width + code, return_inverse=True)
    count = np.bincount(at) if n is None else _sums(at, n, len(cell))
    most = np.zeros(len(cell), np.int64)
    np.maximum.at(most, at, last)
    return ids[cell // width], cell % width, count, most, _sums(at, size, len(cell))


def _sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Exact int64 sums; bincount adds in doubles, so the halves of the values are added apart."""
    low = np.bincount(at, weights=x & 0xFFFFFF, minlength=n).astype(np.int64)
    high = np.bincount(at, weights=x >> 24, minlength=n).astype(np.int64)
    return (high << 24) + low


def _encode(types: list[str], block_rows: int):
    width = len(types) + 1
    order = {t: i for i, t in enumerate(types)}

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        kinds = t["etype"].combine_chunks().dictionary_encode()
        lookup = np.array([order.get(x, width - 1) for x in kinds.dictionary.to_pylist()] + [width - 1], np.int64)
        code = lookup[np.asarray(kinds.indices.fill_null(len(lookup) - 1))]
        ids, codes, n, last, size = _reduce(
            t["srcid"].to_numpy(), code, None, t["ts"].fill_null(0).to_numpy().clip(0), t["byte_size"].fill_null(0).to_numpy(), width
        )
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, codes, n, last, size), _PARTIAL)], schema=_PARTIAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= block_rows:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def feature_columns(types: list[str]) -> list[tuple[str, str]]:
    """Names and types of the output of ``feature_table``."""
    out = [("entity_id", "long"), ("n_events", "long"), ("age_ns", "long"), ("total_bytes", "long")]
    for t in types:
        out += [(f"{t}_n", "long"), (f"{t}_age_ns", "long"), (f"{t}_bytes", "long")]
    return out


def _dense(types: list[str], as_of: int, block_entities: int):
    width = len(types) + 1
    schema = pa.schema([(name, pa.int64()) for name, _ in feature_columns(types)])

    def block(entity, code, n, last, size) -> pa.RecordBatch:
        ids, row = np.unique(entity, return_inverse=True)
        at, shape = row * width + code, (len(ids), width)
        cells = len(ids) * width
        count = _sums(at, n, cells).reshape(shape)
        total = _sums(at, size, cells).reshape(shape)
        most = np.zeros(cells, np.int64)
        np.maximum.at(most, at, last)
        most = most.reshape(shape)
        whole = most.max(axis=1)
        cols = [pa.array(ids), pa.array(count.sum(axis=1)), pa.array(as_of - whole, mask=whole == 0), pa.array(total.sum(axis=1))]
        for j in range(width - 1):
            cols += [pa.array(count[:, j].copy()), pa.array(as_of - most[:, j], mask=most[:, j] == 0), pa.array(total[:, j].copy())]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = ()
        for b in batches:  # sorted by entity
            now = tuple(b.column(i).to_numpy() for i in range(5))
            held = tuple(np.r_[x, y] for x, y in zip(held, now)) if held else now
            starts = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]]) if len(held[0]) else np.array([], int)
            while len(starts) > block_entities:
                end = starts[block_entities]
                yield block(*(x[:end] for x in held))
                held, starts = tuple(x[end:] for x in held), starts[block_entities:] - end
        if held and len(held[0]):
            yield block(*held)

    return run


def feature_table(
    events: DataFrame, types: DataFrame, as_of: int | None = None, block_rows: int = BLOCK_ROWS, block_entities: int = BLOCK_ENTITIES
) -> DataFrame:
    """One row per source: n_events, age_ns, total_bytes, and <type>_n, _age_ns and _bytes for each catalogued type.

    age_ns is the time from the last event to ``as_of`` (by default the largest ts of the table),
    null where no event has a time (ts null or not positive). Bytes are sums of byte_size, null
    counting as 0. Events of null or uncatalogued type count in the three totals only; rows with a
    null source belong to no entity. Repeated rows count each time. Empty events give an empty table.
    """
    names = catalogue(types)
    if as_of is None:
        as_of = events.agg(F.max("ts")).first()[0] or 0
    partial = (
        events.where(F.col("srcid").isNotNull())
        .select("srcid", "etype", F.col("ts").cast("long"), F.col("byte_size").cast("long"))
        .mapInArrow(_encode(names, block_rows), "entity_id long, code int, n long, last long, bytes long")
    )
    schema = ", ".join(f"`{n}` {k}" for n, k in feature_columns(names))
    return partial.repartition("entity_id").sortWithinPartitions("entity_id").mapInArrow(_dense(names, as_of, block_entities), schema)
