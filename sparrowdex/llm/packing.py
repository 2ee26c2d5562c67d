"""Best-fit packing after Martello-Toth dominance reduction.

Pieces are packed by length alone, so the instance is a histogram of at most
``LENGTH`` lengths, whatever the number of documents.  The reduction fixes sets that
dominate every other set for the largest piece: alone, if nothing fits beside it;
with the largest partner, if that fills the sequence, if only one piece fits beside
it, or if no two pieces that fit are longer together and no three fit.  The rest is
packed best-fit decreasing, equal bins at a time.  Then each piece looks up its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import common as C

LENGTH = 4096
CELLS = 64

Bins = list[tuple[int, list[tuple[int, int]]]]


def reduce(left: dict[int, int], capacity: int) -> Bins:
    """Take dominating sets out of the histogram ``left``: (how many bins, [(length, pieces in a bin)]).

    What makes a set dominate stays true when other pieces are taken away, so equal sets are taken together.
    """
    out: Bins = []
    sizes = sorted(n for n in left if left[n])
    for big in reversed(sizes):
        while left[big]:
            left[big] -= 1
            room = capacity - big
            small = _smallest(sizes, left, 3)
            fit = _largest(sizes, left, room)
            if fit is None:
                take: list[int] | None = []
            elif fit == room or len(small) < 2 or small[0] + small[1] > room or (len(small) < 3 or sum(small) > room) and fit >= _best_two(sizes, left, room):
                take = [fit]
            else:
                take = None
            left[big] += 1
            if take is None:
                break
            if not take:
                n = left[big]
            elif take[0] == big:
                n = left[big] // 2
            else:
                n = min(left[big], left[take[0]])
            out.append((n, [(big, 2)] if take == [big] else [(big, 1), *((x, 1) for x in take)]))
            left[big] -= n
            for x in take:
                left[x] -= n
    return out


def _smallest(sizes: list[int], left: dict[int, int], most: int) -> list[int]:
    out: list[int] = []
    for n in sizes:
        out += [n] * min(left[n], most - len(out))
        if len(out) == most:
            break
    return out


def _largest(sizes: list[int], left: dict[int, int], room: int) -> int | None:
    for i in range(bisect.bisect_right(sizes, room) - 1, -1, -1):
        if left[sizes[i]]:
            return sizes[i]
    return None


def _best_two(sizes: list[int], left: dict[int, int], room: int) -> int:
    """The most that two pieces hold together without exceeding ``room``; 0 if no two fit."""
    have = [n for n in sizes[: bisect.bisect_right(sizes, room)] if left[n]]
    best, j = 0, len(have) - 1
    for i, a in enumerate(have):
        while j >= i and (a + have[j] > room or (i == j and left[a] < 2)):
            j -= 1
        if j < i:
            break
        best = max(best, a + have[j])
    return best


def best_fit(left: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing over a histogram; equal bins are filled together."""
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    open_: list[int] = []

    def put(room: int, n: int, held: list[tuple[int, int]]) -> None:
        if n:
            if room not in groups:
                bisect.insort(open_, room)
            groups.setdefault(room, []).append((n, held))

    for size in sorted((n for n in left if left[n]), reverse=True):
        n = left[size]
        while n:
            i = bisect.bisect_left(open_, size)
            if i < len(open_):
                room = open_[i]
                bins, held = groups[room].pop()
                if not groups[room]:
                    del groups[room], open_[i]
            else:
                room, held = capacity, []
                bins = -(-n // (capacity // size))
            each = room // size
            full = min(bins, n // each)
            put(room - each * size, full, [*held, (size, each)])
            n -= full * each
            some = min(n, each - 1) if full < bins else 0
            if some:
                put(room - some * size, 1, [*held, (size, some)])
                n -= some
            put(room, bins - full - bool(some), held)
    return [g for room in groups for g in groups[room]]


def plan(lengths: dict[int, int], capacity: int = LENGTH) -> Bins:
    """Groups of equal sequences that hold every piece of the histogram once."""
    left = dict(lengths)
    fixed = reduce(left, capacity)
    return fixed + best_fit(left, capacity)


def places(bins: Bins) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, by rank: (first rank, first sequence, pieces of this length in a sequence, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, held in bins:
        offset = 0
        for size, each in held:
            first = ranks.get(size, 0)
            out.setdefault(size, []).append((first, sequence, each, offset))
            ranks[size] = first + n * each
            offset += size * each
        sequence += n
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, length: int) -> Iterator[pa.RecordBatch]:
    model = bpe.load(path)
    for b in batches:
        ids, _ = model.encode(["" if t is None else t for t in b.column(1).to_pylist()])
        row, piece, start, size, crc = [], [], [], [], []
        for r, x in enumerate(ids):
            x = np.append(x, end).astype("<u4")
            for p, at in enumerate(range(0, len(x), length)):
                part = x[at : at + length]
                row.append(r)
                piece.append(p)
                start.append(at)
                size.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        long = lambda v: pa.array(v, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(long(row)), pa.array(piece, pa.int32()), long(start), long(size), long(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and the id ``end``; only one with more than ``length``
    ids is cut, into pieces of ``length``.  A null or empty text is one piece of one
    id.  Rows with null or repeated ids or equal texts are packed each by itself; which
    of equal pieces gets which of their places is arbitrary.  Other columns are not looked at; an
    empty table gives an empty result.

    The driver holds the histogram and the groups of equal sequences, which depend on
    ``length`` and not on the number of documents.  Ranks are counted within cells of a
    length, whose number grows with the pieces of that length.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 1000)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = C.cut(rows.mapInArrow(lambda it: _pieces(it, path, end, length), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame([(n, max(CELLS, -(-lengths[n] // 100_000)), v) for n, v in places(plan(lengths, length)).items()], "length long, cells int, places array<struct<first:long,sequence:long,each:int,offset:long>>")
    table = F.broadcast(table)
    cell = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells"))
    placed = pieces.join(F.broadcast(table.select("length", "cells")), "length").withColumn("cell", cell)
    before = placed.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1)
    ranked = ranked.join(before, ["length", "cell"]).withColumn("r", F.col("r") + F.col("before")).drop("cells")
    ranked = ranked.join(table, "length")
    steps = F.lit([1 << k for k in range(24, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s < F.size("places")) & (F.get(F.col("places"), i + s)["first"] <= F.col("r")), i + s).otherwise(i))
    p = F.get(F.col("places"), at)
    out = ranked.withColumn("p", p).withColumn("k", F.col("r") - F.col("p.first"))
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p.sequence") + F.floor(F.col("k") / F.col("p.each"))).cast("long").alias("sequence_id"),
        (F.col("p.offset") + (F.col("k") % F.col("p.each")) * F.col("length")).cast("long").alias("offset"),
    )
