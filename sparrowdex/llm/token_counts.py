"""Token counts by rank-synchronous array merging (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = bpe.load(path)
    for b in batches:
        texts = ["" if t is None else t for t in b.column(1).to_pylist()]
        n = model.encode(texts, with_ids=False)[1]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizer file at ``path`` without begin, end or added
    special tokens; a special string inside a text is one token, as the library
    treats it.  A null or empty text has no bytes and no tokens.  Ids may be null or
    repeated; each row is counted by itself.  Texts of any length are counted whole.
    Other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(lambda it: _count(it, path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
