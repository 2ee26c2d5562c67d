"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform;
its hash is the nearest signed axis.  Several hashes make a bucket of a table.
Multiprobe: a vector is also filed under the buckets in which one hash is replaced
by its second nearest axis.  Vectors that share a bucket are verified by their cosine in
double precision.

The number of hashes follows the largest label's vectors, so that an average bucket stays within a block; the number of
tables follows from how often pairs at the threshold share a bucket of one table, so that but ``MISS`` of them share one of some table.

Equal vectors are one node with a multiplicity.  Pairs are never rows: a bucket is cut
into blocks, two blocks meet in one task as matrices, and what leaves it
is a link count for each node and a spanning forest.  Vectors with one home bucket in the first table meet there, and
in no other bucket again; of other pairs that share several buckets, the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .near_duplicates import BLOCK, blocks

#: The share of pairs at the threshold that may have no bucket in common, and the least hashes of a bucket.
MISS, WIDTH = 1e-4, 2
_U = np.uint64


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Each row over its length, in double precision; scaled first, so that no square overflows or vanishes."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def width_for(vectors: int, dims: int) -> int:
    """Hashes of a bucket with which the buckets of ``vectors`` vectors hold at most a block on average."""
    axes, width = 2 << max(1, (dims - 1).bit_length()), WIDTH
    while axes**width * BLOCK < vectors:
        width += 1
    return width


def tables_for(cosine: float, dims: int, width: int, pairs: int = 500) -> int:
    """Tables with which but ``MISS`` of the pairs at the threshold share a bucket, from pairs drawn at random with that cosine."""
    if dims < 2 or cosine >= 1:
        return 1
    rng = np.random.Generator(np.random.PCG64(4242))
    a, b = unit(rng.normal(size=(pairs, dims))), rng.normal(size=(pairs, dims))
    b = unit(b - (a * b).sum(1, keepdims=True) * a)
    none = np.zeros(pairs, np.int64)
    x, y = (buckets(v, none, 16, width).reshape(pairs, 16, -1) for v in (a, cosine * a + np.sqrt(1 - cosine * cosine) * b))
    shared = float((x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean())
    return int(min(64, max(2, np.ceil(np.log(MISS) / np.log(max(1 - shared, 1e-9))))))


def buckets(v: np.ndarray, labels: np.ndarray, tables: int, width: int) -> np.ndarray:
    """(rows, tables * (1 + width)) bucket keys of unit vectors: in each table the nearest axes, and each hash's second nearest in turn."""
    n, d = v.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = v
    signs = np.random.Generator(np.random.PCG64(90210 + d)).choice([-1.0, 1.0], (tables, width, 3, size))
    keys = np.random.Generator(np.random.PCG64(17)).integers(1, 1 << 63, width + 3, dtype=np.uint64) * _U(2) + _U(1)
    at = np.arange(n)
    out = np.empty((n, tables * (1 + width)), np.uint64)
    with np.errstate(over="ignore"):
        home = labels.astype(np.int64).view(np.uint64) * keys[-1] + _U(d) * keys[-2]
        for t in range(tables):
            best, second = [], []
            for w in range(width):
                y = padded
                for r in range(3):
                    y = _hadamard(y * signs[t, w, r])
                a = np.abs(y)
                i = a.argmax(1)
                best.append((2 * i + (y[at, i] < 0)).astype(np.uint64))
                a[at, i] = -1
                i = a.argmax(1)
                second.append((2 * i + (y[at, i] < 0)).astype(np.uint64))
            for probe in range(width + 1):
                x = home + _U(t + 1) * keys[-3]
                for w in range(width):
                    x = C.mix(x + (second if probe == w + 1 else best)[w] * keys[w])
                out[:, t * (1 + width) + probe] = x
    return out


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a node (a hash of label and components) and the vector's bytes; both null where nothing can be compared."""
    import xxhash

    for b in batches:
        node, raw = [], []
        for x, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            v = None if x is None or label is None or not x or any(c is None for c in x) else np.array(x, np.float64) + 0.0
            if v is None or not np.isfinite(v).all() or not v.any():
                node.append(None)
                raw.append(None)
            else:
                raw.append(v.tobytes())
                node.append(xxhash.xxh64_intdigest(label.to_bytes(8, "little", signed=True) + raw[-1]) - (1 << 63))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node, pa.int64()), pa.array(raw, pa.binary())], ["vec_id", "label", "node", "vec"])


def _by_dimension(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(r) for r in raw])
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield at, unit(np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.float64).reshape(len(at), -1))


def _filed(batches: Iterator[pa.RecordBatch], tables: int, width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        labels = b.column(1).to_numpy()
        keys = np.empty((b.num_rows, tables * (1 + width)), np.uint64)
        for at, v in _by_dimension(b.column(2).to_pylist()):
            keys[at] = buckets(v, labels[at], tables, width)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(C.as_long(np.ascontiguousarray(keys))), pa.list_(pa.int64()))], ["node", "keys"])


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric adjacency matrix."""
    left, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            x = front.pop()
            for y in np.flatnonzero(linked[x] & left).tolist():
                left[y] = False
                out.append((x, y))
                front.append(y)
    return out


def _first_shared(keys: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.uint64) -> np.ndarray:
    """Which rows of left and right share no bucket smaller than ``key``."""
    smaller = np.unique(keys[keys < key])
    if not len(smaller):
        return np.ones((len(left), len(right)), bool)
    member = np.zeros((len(keys), len(smaller)), np.float32)
    r, c = np.nonzero(keys < key)
    member[r, np.searchsorted(smaller, keys[r, c])] = 1
    return member[left] @ member[right].T == 0


def _verified(batches: Iterator[pa.RecordBatch], cosine: float, tables: int, width: int) -> Iterator[pa.RecordBatch]:
    """For each two blocks of a bucket: rows (node, links) and rows (node, other) of a spanning forest."""
    for t in C.whole_groups(batches, ["key", "i", "j"], 2000):
        cols = {c: t.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "comp", "label", "m")}
        raw = t.column("vec").to_pylist()
        edges = C.bounds([cols["key"], cols["i"], cols["j"]])
        A, B, N = [], [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, node, comp, m = (cols[c][lo:hi] for c in ("own", "node", "comp", "m"))
            if hi - lo < 2 or (comp == comp[0]).all():
                continue
            v = unit(np.frombuffer(b"".join(raw[lo:hi]), np.float64).reshape(hi - lo, -1))
            i, j = int(cols["i"][lo]), int(cols["j"][lo])
            x = np.arange(hi - lo)
            left, right = (x, x) if i == j else (x[own == i], x[own == j])
            if not len(left) or not len(right):
                continue
            ok = (v[left] @ v[right].T >= cosine) & (comp[left][:, None] != comp[right][None, :])
            if i == j:
                np.fill_diagonal(ok, False)
            if not ok.any():
                continue
            both = np.zeros((hi - lo, hi - lo), bool)
            both[np.ix_(left, right)] = ok
            if i != j:
                both |= both.T
            used = np.flatnonzero(both.any(1))
            both = both[np.ix_(used, used)]
            key = np.array([cols["key"][lo]], np.int64).view(np.uint64)[0]
            keys = buckets(v[used], cols["label"][lo:hi][used], tables, width)
            home = keys[:, 0]
            if not (home == key).all():
                # pairs of one home bucket are left to it, whatever its number
                every = np.arange(len(used))
                both &= np.where(home[:, None] == home[None, :], (home == key)[:, None], _first_shared(keys, every, every, key))
            gained = both.astype(np.float64) @ m[used]
            at = node[used]
            for k in np.flatnonzero(gained).tolist():
                A.append(int(at[k]))
                B.append(None)
                N.append(int(gained[k]))
            for a, b in _forest(both):
                A.append(int(at[a]))
                B.append(int(at[b]))
                N.append(0)
        if A:
            yield pa.RecordBatch.from_arrays([pa.array(A, pa.int64()), pa.array(B, pa.int64()), pa.array(N, pa.int64())], ["a", "b", "n"])


def embedding_near_duplicates(vectors: DataFrame, cosine: float = 0.98, tables: int | None = None, width: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and they have as many
    components; pairs with a cosine of ``cosine`` or more in double precision are
    links.  A null, empty or zero vector and one with null or non-finite components
    has no links.  Rows that repeat an id or a vector are vectors of their own.
    ``component_id`` is the smallest id reachable; a null id counts as larger than
    all others.  Other columns are not looked at; an empty table gives an empty result.

    ``width`` hashes make a bucket of each of ``tables`` tables; where they are not given, ``width_for`` the label with
    most distinct vectors and ``tables_for`` the threshold.
    """
    spark = vectors.sparkSession
    C.small_batches(spark, 2000)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    base = C.cut(rows.mapInArrow(_valid, "vec_id long, label long, node long, vec binary"), "vectors")
    nodes = base.where("node is not null").groupBy("node").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    nodes = C.cut(nodes, "nodes")
    most = nodes.groupBy("label", F.length("vec").alias("bytes")).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).head()
    dims = (most.bytes or 16) // 8
    width = width or width_for(most.n or 0, dims)
    tables = tables or tables_for(cosine, dims, width)
    filed = nodes.select("node", "label", "vec").mapInArrow(lambda it: _filed(it, tables, width), "node long, keys array<long>")
    # in the first table's home bucket all pairs are looked at, in others those of different homes
    home = F.get("keys", F.lit(0))
    posts = filed.select("node", home.alias("home"), F.explode(F.array_distinct("keys")).alias("key"))
    posts = C.cut(posts.select("key", "node", F.when(F.col("key") == F.col("home"), F.col("node")).otherwise(F.col("home")).alias("comp")), "posts")
    size = C.cut(posts.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")), "bucket-sizes")
    rows = C.looked_up(posts, "key", size.select("key", "n"), size.where("lo <> hi").select("key", F.col("n").alias("m")))
    rows = C.cut(blocks(C.cut(rows, "shared")), "dealt")
    rows = rows.join(nodes, "node").select("key", "i", "j", "own", "node", "comp", "label", "m", "vec")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = C.cut(rows.mapInArrow(lambda it: _verified(it, cosine, tables, width), "a long, b long, n long"), "found")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    label = components(found.where("b is not null").select("a", "b"), smallest=False)
    named = nodes.select("node", "m", "least").join(label, "node", "left").join(links, "node", "left")
    named = C.cut(named.select("node", "least", F.coalesce("comp", "node").alias("comp"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
    low = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(low, "comp").select("node", "n_links", "component_id")
    out = base.where("node is not null").select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = base.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    C.drop(posts, size, found, label)
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
