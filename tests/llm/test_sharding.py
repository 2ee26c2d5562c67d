import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import EDGE, make_documents, prose

from sparrowdex.llm.sharding import flows, ring, shard


def walked(arcs, owner, capacity):
    """The same by single keys: homes first, then the overflow, one key at a time, clockwise."""
    room, home, over = list(capacity), Counter(), []
    for a, n in enumerate(arcs):
        for _ in range(n):
            if room[owner[a]]:
                room[owner[a]] -= 1
                home[a, owner[a]] += 1
            else:
                over.append(a)
    for a in over:
        step = a
        while True:
            step = (step + 1) % len(owner)
            if room[owner[step]]:
                room[owner[step]] -= 1
                home[a, owner[step]] += 1
                break
    return home


def test_flows_are_those_of_single_keys():
    rng = random.Random(1)
    for _ in range(200):
        shards = rng.randint(1, 5)
        owner = [*range(shards), *(rng.randrange(shards) for _ in range(rng.randint(0, 15)))]
        rng.shuffle(owner)
        arcs = [rng.choice([0, 1, 3, 40]) for _ in owner]
        total = sum(arcs)
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
        got = Counter()
        ranks = defaultdict(list)
        for a, lo, hi, s in flows(arcs, owner, capacity):
            got[a, s] += hi - lo
            ranks[a].append((lo, hi))
        assert +got == +walked(arcs, owner, capacity)
        for a, held in ranks.items():
            assert [x for lo, hi in sorted(held) for x in range(lo, hi)] == list(range(arcs[a]))


def check(out, rows, shards):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("rows", None)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_edges(spark, edge, nothing, shards):
    check(shard(edge, shards, 10).collect(), EDGE, shards)
    assert shard(nothing, shards, 10).count() == 0


def test_balance_with_one_hot_id_and_text(spark):
    rng = random.Random(2)
    rows = [(7 if i % 3 == 0 else i, "one and the same" if i % 3 == 1 else prose(rng, 5), "en", "s") for i in range(3000)]
    check(shard(make_documents(spark, rows)).collect(), rows, 16)


def test_most_rows_stay_at_home_and_few_move(spark):
    rows = [(i, f"text {i}", "en", "s") for i in range(4000)]
    points = ring(16, 100, spark)
    positions = [p for p, _ in points]
    import bisect

    pos = {r.doc_id: r.h for r in spark.range(4000).selectExpr("id AS doc_id", "xxhash64(id) AS h").collect()}
    home = {i: points[bisect.bisect_left(positions, p) % len(points)][1] for i, p in pos.items()}
    a = {r.doc_id: r.shard for r in shard(make_documents(spark, rows)).collect()}
    assert sum(a[i] == home[i] for i in a) > 0.85 * len(a)
    b = {r.doc_id: r.shard for r in shard(make_documents(spark, rows + [(4000 + i, "more", "en", "s") for i in range(40)])).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.1 * len(a)
