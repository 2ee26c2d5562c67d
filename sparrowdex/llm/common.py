"""Helpers that the operators share: durable cuts, grouped Arrow streams, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- durable cuts


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all runs on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparrowdex-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Tables that ``cut`` has written in this process and that are not deleted yet.
_made: set[str] = set()


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: short lineage that survives lost executors.

    Where at most ``rows`` narrow rows are known to come, small partitions are joined, so that no swarm of tiny files is written.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // 100_000)))
    path = f"{shared_dir(spark)}/sparrowdex/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparrowdex_path = path
    _made.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.discard(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_sparrowdex_path", None)
        if path:
            _delete(df.sparkSession, path)


def made() -> frozenset[str]:
    """The tables that are there now."""
    return frozenset(_made)


def sweep(spark: SparkSession, since: frozenset[str] = frozenset(), *keep: DataFrame) -> None:
    """Delete all tables that ``cut`` has written ``since`` and that aren't to be kept.

    A result that an operator returns reads some of its tables when it is used, so
    this is for the time when such results have been written.
    """
    kept = {getattr(df, "_sparrowdex_path", None) for df in keep}
    for path in _made - since - kept:
        _delete(spark, path)


def looked_up(rows: DataFrame, key: str, counts: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``key``), where many rows may have one key.

    ``counts`` (key, n) has the rows of each key.  Keys with more than a ten-thousandth of all rows, of which there can't be more than
    10,000, are broadcast with what the table says of them, so their rows stay where they are; the others are shuffled.
    ``rows`` is read twice, so it should be a written table.
    """
    total = counts.agg(F.sum("n")).head()[0] or 0
    hot = counts.where(F.col("n") > max(total / 10_000, 64)).select(key).limit(10_001)
    hot = F.broadcast(cut(hot.coalesce(1), "hot"))
    found = table.join(hot, key)
    return rows.join(hot, key, "left_semi").join(F.broadcast(found), key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows and 4 MB, so that whole texts on both sides of the pipe stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    """The path of an installed public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(id_col: Column) -> Column:
    """True for the third of ids whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def column(batch: pa.RecordBatch, name: str) -> list:
    """The column's values; nulls if there is no such column."""
    return batch.column(name).to_pylist() if name in batch.schema.names else [None] * batch.num_rows


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of which ``keep(batch)`` says True, with all their columns; no row is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(b), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


# ------------------------------------------------- streams of whole key groups


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that never split a run of equal ``keys`` (the input is sorted by them)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(held)
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if not len(at):
            rows = 2 * size
            continue
        last = int(at[-1]) + 1
        yield t.slice(0, last)
        held = t.slice(last).combine_chunks().to_batches()
        size = t.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), bool)
    for v in columns:
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)


# ----------------------------------------------------------------- word hashes

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_TAB = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word when words are split at ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word when words are runs of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_WINDOW = 1 << 20
_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _WINDOW
    while size < n:
        size *= 2
    if size not in _pows:
        _pows.clear()
        with np.errstate(over="ignore"):
            a, b = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
            a[0] = b[0] = 1
            _pows[size] = np.cumprod(a), np.cumprod(b)
    return _pows[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U(33))
        x = x * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _window_words(a: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = is_word[a]
    edge = np.diff(np.concatenate([[False], w, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _powers(len(a))
    with np.errstate(over="ignore"):
        h = np.cumsum(_TAB[_LOWER[a]] * up[: len(a)], dtype=np.uint64)
        before = np.where(start > 0, h[start - 1], _U(0))
        return mix((h[end - 1] - before) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(data: bytes, is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of UTF-8 ``data`` with A-Z lower-cased, and where each begins.

    Works through windows that end between words, so memory does not grow with a
    text beyond its bytes and its words.
    """
    a = np.frombuffer(data, np.uint8)
    if len(a) <= _WINDOW:
        return _window_words(a, is_word)
    out, at, i = [], [], 0
    while i < len(a):
        size = _WINDOW
        while True:
            j = min(len(a), i + size)
            if j == len(a):
                break
            gaps = np.flatnonzero(~is_word[a[i:j]])
            if len(gaps):
                j = i + int(gaps[-1]) + 1
                break
            size *= 2
        h, s = _window_words(a[i:j], is_word)
        out.append(h)
        at.append(s + i)
        i = j
    return np.concatenate(out), np.concatenate(at)


def batch_words(texts: list[bytes], is_word: np.ndarray = SPACED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word_hashes`` of each text, many short texts in one pass."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < _WINDOW - 4096 and j - i < 2048):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            yield word_hashes(texts[i], is_word)
        else:
            h, s = word_hashes(b"\n".join(texts[i:j]), is_word)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            cuts = np.searchsorted(s, ends)
            low = 0
            for k, hi in enumerate(cuts.tolist()):
                yield h[low:hi], s[low:hi] - (int(ends[k - 1]) if k else 0)
                low = hi
        i = j


_C = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; the whole sequence as one if it has fewer words; none without words."""
    n = len(words)
    if not n:
        return words
    m = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - m + 1, _U(0x51ED27 + m), np.uint64)
        for j in range(m):
            out += words[j : n - m + 1 + j] * _C[j]
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
