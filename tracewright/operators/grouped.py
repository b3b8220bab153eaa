"""Python over many small groups without a call from Spark for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (key, columns of the group as lists by name) to rows.
Group = Callable[[object, dict[str, list]], list[tuple]]


def over_groups(df: DataFrame, key: str, run: Group, schema: str, arrow: pa.Schema) -> DataFrame:
    """The rows of ``run`` for each group of ``key``.

    For groups that are small and many, such as the communities or snapshots of a log: rows are
    hash partitioned and sorted by the key, and each Arrow batch gives its groups in one go. Only
    a batch's last group, which may go on in the next, is held over.
    """

    def groups(table: pa.Table, starts: np.ndarray) -> list[tuple]:
        columns = {n: table[n].to_pylist() for n in table.column_names}
        keys, out = columns[key], []
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            out += run(keys[a], {n: c[a:b] for n, c in columns.items()})
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
            codes = np.asarray(table[key].combine_chunks().dictionary_encode().indices)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist()
            last = starts.pop()
            held = table.slice(last)
            if starts and (rows := groups(table.slice(0, last), starts)):
                yield batch_of(rows)
        if held is not None and (rows := groups(held, [0])):
            yield batch_of(rows)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(walk, schema)
