import random
import re

import pytest
from conftest_llm import EDGE, make_documents, prose

from sparrowdex.llm.near_duplicates import ERRORS, near_duplicates, without_near_duplicates


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    """(doc_id, set size, component id) of each row, by comparing all pairs."""
    sets = [shingle_set(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def copies(seed, families=25, hot=120):
    """Families of copies edited more and less, one of them large, so that many pairs are near the threshold."""
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = prose(rng, rng.choice([3, 8, 40, 90, 200])).split()
        for _ in range(hot if f == 0 else rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = prose(rng, 1)
            if rng.random() < 0.2:
                words += prose(rng, rng.randint(1, 10)).split()
            rows.append((len(rows) * 7 % 1009, " ".join(words), "en", "src0"))
    return rows


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 3, 85), (2, 5, 80)])
def test_components_are_those_of_brute_force(spark, seed, k, num):
    rows = copies(seed)
    out = near_duplicates(make_documents(spark, rows), k, num, 100)
    assert found(out) == brute(rows, k, num, 100)


def test_a_large_group_of_near_copies_that_are_not_all_linked(spark):
    rng = random.Random(3)
    base = prose(rng, 150).split()
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = prose(rng, 1)
        rows.append((i, " ".join(words), "en", "src0"))
    assert found(near_duplicates(make_documents(spark, rows), 3, 85, 100)) == brute(rows, 3, 85, 100)


def test_edges(spark, edge, nothing):
    out = near_duplicates(edge, 3, 85, 100)
    assert found(out) == brute(EDGE, 3, 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())
    assert near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays(spark, edge, nothing):
    left = without_near_duplicates(edge)
    assert left.columns == edge.columns
    texts = sorted(str(r.text)[:40] for r in left.collect())
    every = sorted({str(t)[:40] for _, t, *_ in EDGE})
    assert texts == every
    assert without_near_duplicates(nothing).count() == 0


def test_the_errors_allowed_leave_a_chunk_with_one_at_most():
    assert ERRORS < 2 * 7


def test_nodes_of_different_components_meet_in_one_pair_of_blocks(spark, monkeypatch):
    """Of a key beyond a block: pairs across components exactly once, those within a large component only within a block."""
    from collections import Counter

    from sparrowdex.llm import near_duplicates as N

    monkeypatch.setattr(N, "BLOCK", 8)
    of = {n: 1000 if n < 60 else 2000 if n < 90 else 3000 + n % 5 if n < 110 else n for n in range(130)}
    rows = [(1, n, c, len(of)) for n, c in of.items()] + [(2, n, of[n], 6) for n in range(57, 63)]
    out = N.blocks(spark.createDataFrame(rows, "key long, node long, comp long, m long")).collect()
    meet = Counter()
    by = {}
    for r in out:
        by.setdefault((r.key, r.i, r.j), []).append(r)
    for (key, i, j), held in by.items():
        assert len({r.node for r in held}) == len(held)
        left, right = [r.node for r in held if r.own == i], [r.node for r in held if r.own == j]
        assert len(left) + (0 if i == j else len(right)) == len(held)
        meet.update((key, min(a, b), max(a, b)) for a in left for b in right if (a < b if i == j else True))
    for key, nodes in ((1, range(130)), (2, range(57, 63))):
        for a in nodes:
            for b in range(a + 1, max(nodes) + 1):
                assert meet[key, a, b] == 1 if of[a] != of[b] else meet[key, a, b] <= 1
    assert not any(meet[1, a, b] for a in range(60) for b in range(a + 1, 60))  # a large component's own blocks don't meet


def test_hot_keys_are_looked_up_as_others(spark, monkeypatch):
    from sparrowdex.llm import common as C

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(900)], "k long, v long")
    table = spark.createDataFrame([(k, k * 10) for k in range(0, 900, 2)] + [(1, 7)], "k long, w long")
    got = C.looked_up(rows, "k", rows.groupBy("k").count().toDF("k", "n"), table)
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == sorted(map(tuple, rows.join(table, "k").select("k", "v", "w").collect()))
    left = C.looked_up(rows, "k", rows.groupBy("k").count().toDF("k", "n"), table.where("k <> 1"), "left")
    assert sorted(map(str, left.select("k", "v", "w").collect())) == sorted(map(str, rows.join(table.where("k <> 1"), "k", "left").select("k", "v", "w").collect()))
    empty = rows.where("false")
    assert C.looked_up(empty, "k", empty.groupBy("k").count().toDF("k", "n"), table).count() == 0


def test_columns_of_any_name_and_repeated_rows_in_the_filter(spark):
    from sparrowdex.llm.near_duplicates import without_near_duplicates

    text = "one two three four five six seven"
    rows = [(1, text, "b", 1), (1, text, "a", 2), (1, text, "a", 2), (2, text, "c", 3), (3, None, "d", 4), (3, "", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, `row.id` int").withColumnRenamed("row.id", "stay_hash")
    out = [tuple(r) for r in without_near_duplicates(docs).collect()]
    again = [tuple(r) for r in without_near_duplicates(docs.repartition(5)).collect()]
    assert sorted(out, key=str) == sorted(again, key=str)
    assert len(out) == 3
    assert {r[2] for r in out} in ({"a", "d", "e"}, {"b", "d", "e"})
