"""Token ids and counts of texts under a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Default vocabulary file; every operator takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a rank file, loaded once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(rows: DataFrame, text: str, path: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """``rows`` with the text column replaced by n_tokens, and with ``ids`` by tokens as well.

    Whole texts are encoded; a null or empty text has 0 tokens (and an empty list).
    """
    kept = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in kept]
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at]
            found = [encode(t) if t else [] for t in batch.column(at).to_pylist()]
            cols.append(pa.array([len(x) for x in found], pa.int64()))
            if ids:
                cols.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_tokens", *(["tokens"] if ids else [])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, n_tokens long" + (", tokens array<int>" if ids else ""))
