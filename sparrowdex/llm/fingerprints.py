"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

All 5-word shingles of a text are hashed once; the hash names one of ``BINS`` bins
and the rest competes for the bin's minimum.  An empty bin takes the minimum of a
bin found by hashing (bin, attempt) until one is not empty, which is the same for
every text with the same non-empty bins.  The low ``BITS`` bits of each bin are stored; the share of equal
bins is corrected for the bits that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BINS, BITS, WORDS = 256, 8, 5
_ATTEMPTS = 64
_probe = np.random.Generator(np.random.PCG64(4242)).integers(0, BINS, (BINS, _ATTEMPTS))
_U = np.uint64


def fingerprint(words: np.ndarray) -> bytes:
    """The packed bins; no bytes for a text without words."""
    s = C.shingles(words, WORDS)
    if not len(s):
        return b""
    bins = (s >> _U(56)).astype(np.int64)
    low = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, bins, s & _U((1 << 56) - 1))
    full = low != np.iinfo(np.uint64).max
    if not full.all():
        empty = np.flatnonzero(~full)
        hit = full[_probe[empty]]
        first = hit.argmax(1)
        donor = _probe[empty, first]
        lost = ~hit.any(1)
        if lost.any():  # few bins are full: the nearest full one clockwise
            have = np.flatnonzero(full)
            donor[lost] = have[np.searchsorted(have, empty[lost]) % len(have)]
        low[empty] = low[donor]
    return C.mix(low).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated similarity of two texts' shingle sets from their fingerprints; two empty texts are alike, an empty and another one not."""
    if not a or not b:
        return float(a == b)
    chance = 2.0**-BITS
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edit(text: str, following: str) -> str:
    """The last third of the text's code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]



def _row(doc_id, text: str, following: str, mine: bytes, theirs: bytes) -> tuple:
    edited = edit(text, following)
    raw = edited.encode()
    new = mine if edited == text else fingerprint(C.word_hashes(raw)[0])
    return doc_id, len(text), hashlib.sha256(raw).digest(), mine, new, likeness(mine, new), likeness(mine, theirs)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGE = pa.schema([*_ARROW, ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with the row that follows; the first and the last text of a partition are handed on as edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last = None  # (doc_id, text, fingerprint)
    none = (None,) * 7
    for b in batches:
        ids = b.column(0).to_pylist()
        raw = C.text_bytes(b.column(1))
        out = []
        if last is None and ids:
            out.append((*none, part, "first", raw[0].decode()))
        for doc_id, data, (words, _) in zip(ids, raw, C.batch_words(raw), strict=True):
            text, print_ = data.decode(), fingerprint(words)
            if last is not None:
                out.append((*_row(last[0], last[1], text, last[2], print_), part, None, None))
            last = (doc_id, text, print_)
        if out:
            yield _table(out, _EDGE)
    if last is not None:
        yield _table([(last[0], *none[1:], part, "last", last[1])], _EDGE)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, text, following in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            text, following = text or "", following or ""
            mine, theirs = (fingerprint(C.word_hashes(x.encode())[0]) for x in (text, following))
            out.append(_row(doc_id, text, following, mine, theirs))
        yield _table(out, _ARROW)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points replaced by the beginning of
    the next document, by descending id (null ids last, equal ids by their texts); the
    last is followed by the first.  A null text is empty.  A text without words has an
    empty fingerprint, which is like another empty one only.  Likeness is 0 to 1.
    Other columns are not looked at; an empty table gives an empty result.

    Texts are dealt once, by ranges of ids; only the first and last row of a range
    are looked at again, and the driver learns only which ranges have rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 400)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(*by[:2]).sortWithinPartitions(*by)
    done = C.cut(dealt.mapInArrow(_runs, f"{_SCHEMA}, part int, edge string, text string"), "fingerprints")
    edges = done.where("edge is not null")
    parts = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())
    hexed = lambda df: df.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
    if not parts:
        return hexed(done.drop("part", "edge", "text"))
    order = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, follows int")
    ends = edges.where("edge = 'last'").select("part", "doc_id", F.col("text").alias("own")).join(F.broadcast(order), "part")
    heads = edges.where("edge = 'first'").select(F.col("part").alias("follows"), F.col("text").alias("following"))
    rest = ends.join(heads, "follows").select("doc_id", "own", "following").mapInArrow(_joined, _SCHEMA)
    return hexed(done.where("edge is null").drop("part", "edge", "text").union(rest))
