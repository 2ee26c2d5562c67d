"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 64


def ring(shards: int, vnodes: int, spark) -> list[tuple[int, int]]:
    """Sorted (position, shard) of all virtual nodes; positions are Spark's xxhash64, as those of keys are."""
    points = spark.range(shards * vnodes).select(F.xxhash64(F.lit("vnode"), "id").alias("pos"), (F.col("id") / vnodes).cast("int").alias("shard"))
    return sorted((r.pos, r.shard) for r in points.collect())


def flows(arcs: list[int], owner: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Who takes what: (arc, first rank, end rank, shard), the ranks being those of an arc's keys.

    First each shard takes the keys of its own arcs, in the ring's order, as far as
    its capacity goes.  Then what overflowed from each arc, again in the ring's
    order, walks clockwise from virtual node to virtual node and fills the first
    shards that have room.
    """
    room = list(capacity)
    out, over = [], []
    for a, n in enumerate(arcs):
        take = min(n, room[owner[a]])
        room[owner[a]] -= take
        if take:
            out.append((a, 0, take, owner[a]))
        if take < n:
            over.append((a, take, n))
    for a, lo, hi in over:
        step = a
        while lo < hi:
            step = (step + 1) % len(owner)
            s = owner[step]
            take = min(hi - lo, room[s])
            if take:
                room[s] -= take
                out.append((a, lo, lo + take, s))
                lo += take
    return out


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A key's home is the shard of the first virtual node at or after the hash of its
    id.  Capacities are the rows divided by the shards, the first shards of the ring
    having one more where that doesn't divide, so no two shards ever differ by more
    than a row (law ``rows``); only keys of shards that are full leave home, and they
    go clockwise to the first shard with room.  ``slot`` numbers a shard's rows
    without gaps from 0.  ``size`` is the text's UTF-8 bytes plus 1, a null text
    having none and the checksum of an empty one; ``grown_shard`` is null, as this
    law moves rows between old shards when one is added.  Rows with one id share a
    place on the ring and are spread over the cells of their arc by their texts; a null id is a key like
    any other; equal rows get slots of their own, in any order.  Other columns are
    not looked at; an empty table gives an empty result.

    What reaches the driver is a count for each arc and cell, whose number is fixed by
    the parameters.  The only shuffle of rows ranks them within a cell, a 64th of
    an arc.
    """
    spark = docs.sparkSession
    points = ring(shards, vnodes, spark)
    positions, owner = [p for p, _ in points], [s for _, s in points]
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col).cast("long")).alias("pos"),
        F.pmod(F.xxhash64(F.lit("cell"), F.col(id_col), text), F.lit(CELLS)).cast("int").alias("cell"),
    )
    # the arc of a position: how many virtual nodes lie before it, found by halving
    edges = F.lit(positions)
    steps = F.lit([1 << k for k in range(len(positions).bit_length() - 1, -1, -1)])
    nodes_before = F.aggregate(steps, F.lit(0), lambda i, step: F.when((i + step <= len(positions)) & (F.get(edges, i + step - 1) < F.col("pos")), i + step).otherwise(i))
    rows = rows.withColumn("arc", F.pmod(nodes_before, F.lit(len(positions)))).select("doc_id", "size", "text_crc32", "arc", "cell")

    counts = {(r.arc, r.cell): r.n for r in rows.groupBy("arc", "cell").agg(F.count("*").alias("n")).collect()}
    arcs = [sum(counts.get((a, c), 0) for c in range(CELLS)) for a in range(len(positions))]
    total = sum(arcs)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    before: dict[tuple[int, int], int] = {}
    for a in range(len(positions)):
        n = 0
        for c in range(CELLS):
            before[a, c] = n
            n += counts.get((a, c), 0)
    # each piece of a flow that lies in a cell: the ranks within the cell, the shard, the slot of the first
    taken = [0] * shards
    places: dict[tuple[int, int], list] = {}
    for a, lo, hi, s in flows(arcs, owner, capacity):
        starts = [before[a, c] for c in range(CELLS)]
        c = bisect.bisect_right(starts, lo) - 1
        while lo < hi:
            end = min(hi, before[a, c] + counts.get((a, c), 0))
            if end > lo:
                places.setdefault((a, c), []).append((lo - before[a, c], s, taken[s] - (lo - before[a, c])))
                taken[s] += end - lo
                lo = end
            c += 1
    table = spark.createDataFrame([(a, c, v) for (a, c), v in places.items()], "arc int, cell int, places array<struct<first long, shard int, shift long>>")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("arc", "cell").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1)
    placed = ranked.join(table, ["arc", "cell"]).withColumn("p", F.element_at(F.filter("places", lambda x: x["first"] <= F.col("r")), -1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("p.shard").alias("shard"), (F.col("r") + F.col("p.shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
