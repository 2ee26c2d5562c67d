import numpy as np
import pytest

from sparrowdex.llm.embeddings import embedding_near_duplicates


def brute(rows, cosine):
    """(vec_id, links, component id) of each row."""
    n = len(rows)
    ok = np.zeros((n, n), bool)
    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, float)
        unit.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                ok[i, j] = unit[i] @ unit[j] >= cosine
    comp = list(range(n))
    for s in range(n):
        stack = [s] if comp[s] == s else []
        seen = set(stack)
        while stack:
            x = stack.pop()
            comp[x] = comp[s]
            for y in np.flatnonzero(ok[x]).tolist():
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[comp[i]] = min(low.get(comp[i], r[0]), r[0])
    return sorted(((rows[i][0], int(ok[i].sum()), low.get(comp[i])) for i in range(n)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, node int, key int, m int").repartition(3)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("dims", [64, 10])
def test_links_are_those_of_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    rows = []
    for label in range(3):
        for _ in range(12):
            centre = rng.normal(size=dims)
            for _ in range(rng.integers(1, 60 if label == 0 else 5)):
                v = centre + rng.normal(size=dims) * 0.16
                rows.append((len(rows), v.astype(np.float32).tolist(), label))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(30)]
    rows += [(10_000, rows[0][1], 2)]
    want, got = brute(rows, 0.98), found(embedding_near_duplicates(table(spark, rows)))
    recall = sum(x[1] for x in got) / sum(x[1] for x in want)
    assert recall >= 0.999
    assert all(a[1] <= b[1] for a, b in zip(sorted(got, key=lambda x: x[0]), sorted(want, key=lambda x: x[0]), strict=True))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, None, 0), (2, v, None), (3, [], 0), (4, [0.0] * 4, 0), (5, [1.0, None, 3.0, 4.0], 0), (6, [nan] * 4, 0), (7, [inf, 1.0, 1.0, 1.0], 0), (8, v, 0), (9, v, 0), (9, v, 0), (None, v, 0), (None, [9.0, -1.0, 0.0, 2.0], 0),
        (10, v, 1), (11, [2.0, 4.0, 6.0, 8.0], 0), (12, [1.0, 2.0, 3.0], 0), (13, [1e-38, 2e-38, 3e-38, 4e-38], 0), (14, [1e38, 2e38, 3e38, 3.4e38], 0), (15, [-1.0, -2.0, -3.0, -4.0], 0), (16, [-0.0, 1.0, 0.0, 0.0], 0), (17, [0.0, 1.0, 0.0, 0.0], 0), (18, [5.0], 0), (19, [7.0], 0),
    ]
    df = table(spark, rows)
    as_float = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], y) for i, x, y in rows]
    out = embedding_near_duplicates(df)
    assert found(out) == brute(as_float, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())
    assert embedding_near_duplicates(table(spark, [])).count() == 0


def test_the_supplied_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert found(embedding_near_duplicates(df)) == brute(rows, 0.98)


def test_tables_find_the_pairs_at_the_threshold():
    """Pairs exactly at the threshold, that the tables were not chosen by, share a bucket but for few."""
    from sparrowdex.llm.embeddings import buckets, tables_for, unit, width_for

    rng = np.random.default_rng(8)
    for dims, vectors in ((64, 1000), (64, 10**8), (10, 10**6), (300, 10**6)):
        width = width_for(vectors, dims)
        tables = tables_for(0.98, dims, width)
        a, g = unit(rng.normal(size=(2000, dims))), rng.normal(size=(2000, dims))
        g = unit(g - (a * g).sum(1, keepdims=True) * a)
        none = np.zeros(2000, np.int64)
        x, y = buckets(a, none, tables, width), buckets(0.98 * a + np.sqrt(1 - 0.98**2) * g, none, tables, width)
        assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() >= 0.998, (dims, vectors)
    assert width_for(10**9, 64) > width_for(10**6, 64)


def test_a_group_larger_than_a_block(spark):
    """Near copies in many blocks, with some that leave the group's home bucket."""
    rng = np.random.default_rng(21)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * (0.05 if i % 7 else 0.14)).astype(np.float32).tolist(), 0) for i in range(1300)]
    rows += [(2000 + i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(200)]
    want, got = brute(rows, 0.98), found(embedding_near_duplicates(table(spark, rows)))
    assert sum(x[1] for x in got) >= 0.999 * sum(x[1] for x in want)
    assert all(a[1] <= b[1] for a, b in zip(sorted(got, key=lambda x: x[0]), sorted(want, key=lambda x: x[0]), strict=True))
    assert [x[::2] for x in got] == [x[::2] for x in want]
