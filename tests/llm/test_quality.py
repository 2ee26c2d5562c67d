import numpy as np
from conftest_llm import EDGE

from sparrowdex.llm import quality as Q
from sparrowdex.llm.queries import op2_quality_classifier


def test_features_of_single_texts_and_of_a_batch_are_the_same():
    texts = [(t or "").encode() for _, t, *_ in EDGE]
    together = Q.text_features(texts)
    assert together.shape == (len(texts), len(Q.TEXT_NAMES))
    assert np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(Q.text_features([t])[0], together[i])


def views(rng, y):
    """Two views that are independent given the label; the second is the weaker one."""
    return y[:, None] * 2.0 + rng.normal(size=(len(y), 3)), y[:, None] * 1.2 + rng.normal(size=(len(y), 2))


def test_co_training_learns_from_unlabelled_rows():
    rng = np.random.default_rng(2)
    gains = []
    for _ in range(10):
        truth = rng.integers(0, 2, 3000)
        a, b = views(rng, truth)
        y = np.full(3000, -1)
        y[:30] = truth[:30]
        test = slice(2000, 3000)
        right = [((m.score(a[test], b[test]) >= 0.5) == truth[test]).mean() for m in (Q.cotrain(a[:2000], b[:2000], y[:2000]), Q.cotrain(a[:2000], b[:2000], y[:2000], rounds=0))]
        gains.append(right[0] - right[1])
    assert np.mean(gains) > 0


def test_a_view_without_information_does_no_harm():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 2000)
    a, _ = views(rng, truth)
    noise = rng.normal(size=(2000, 4))
    y = np.where(np.arange(2000) < 1000, truth, -1)
    m = Q.cotrain(a, noise, y)
    assert ((m.score(a, noise) >= 0.5) == truth).mean() > 0.93


def test_scores_are_calibrated():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 2, 9000)
    a, b = views(rng, truth)
    m = Q.cotrain(a[:3000], b[:3000], truth[:3000])
    p = m.score(a[3000:], b[3000:])
    for lo in (0.1, 0.3, 0.5, 0.7):
        at = (p >= lo) & (p < lo + 0.2)
        assert abs(truth[3000:][at].mean() - p[at].mean()) < 0.12


def test_edges(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.learn(edge, none) is None
    assert Q.learn(nothing, none) is None
    assert {r.score for r in Q.quality(edge, None).collect()} == {1.0}
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (4, 0, 0), (5, 1, 0), (6, 1, 0), (-3, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    m = Q.learn(edge, labels)
    out = Q.quality(edge, m).collect()
    assert len(out) == len(EDGE)
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in out)
    left = Q.without_poor(edge, m)
    assert left.columns == edge.columns
    assert left.count() == sum(r.kept for r in out)
    assert Q.quality(nothing, m).count() == 0
    assert Q.quality(edge.select("doc_id", "text"), m).count() == len(EDGE)  # without metadata columns


def test_held_out_rows_of_the_supplied_table(spark):
    out = op2_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in out]) >= 0.98
    assert np.mean([r.kept for r in out if r.quality == 1]) >= 0.99


def test_a_bounded_sample_has_the_prior_of_all_labelled_rows(spark):
    import json
    import random

    from conftest_llm import make_documents, prose

    rng = random.Random(5)
    rows = [(i, prose(rng, 40 if i % 10 else 8), "en", "src0") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(400)] + [(i, 0) for i in range(1000, 1300)], "doc_id long, quality int")
    m = Q.learn(make_documents(spark, rows), labels, sample=600)
    assert np.isclose(json.loads(m.spec)["prior"], np.log(9))
    m = Q.learn(make_documents(spark, rows), labels.where("doc_id < 1000"), sample=40)
    assert np.isclose(json.loads(m.spec)["prior"], np.log(9))


def plain_features(text):
    """``TEXT_NAMES`` of one text, word by word and sign by sign."""
    import math
    import re
    from collections import Counter

    data = text.encode()
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    n = len(words)
    if not n:
        return [0.0] * (len(Q.TEXT_NAMES) - 1) + [1.0]
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    gaps = [b - a - 1 for a, b in zip(starts, [*starts[1:], len(data) + 1], strict=True)]
    count = lambda signs: sum(data.count(bytes([c])) for c in signs)
    punctuation, letters = b"\"'(),-.:;", bytes([*range(65, 91), *range(97, 123)])
    white, ends = count(b"\t\x0b\x0c "), count(b"\n\r")
    solid = max(1, len(data) - white - ends)
    other = sum(c < 128 and c not in letters + punctuation + b"0123456789!?\t\x0b\x0c\n\r " for c in data)
    three = {tuple(words[i : i + 3]) for i in range(max(1, n - 2))}
    freq = [k / len(data) for k in Counter(data).values()]
    mean = sum(gaps) / n
    return [
        math.log1p(n), min(solid / n, 30), min(math.sqrt(sum((g - mean) ** 2 for g in gaps) / n), 30), count(bytes(range(65, 91))) / solid, count(b"0123456789") / solid, count(punctuation) / n, sum(c > 127 for c in data) / solid, ends / n, count(b"!?") / n,
        other / solid, len(set(words)) / n**0.85, max(Counter(words).values()) / n, len(three) / max(1, n - 2), math.log1p(len(set(data))), -sum(p * math.log(p) for p in freq), math.log1p(max(gaps)), 0.0,
    ]


def plain_logistic(x, y, penalty, weight):
    """Log odds by a model fitted with damped Newton steps on the penalised likelihood, started anew."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    b = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ b))
        gradient = z.T @ (weight * (y - p)) - ridge @ b
        hessian = sum(w * q * (1 - q) * np.outer(r, r) for w, q, r in zip(weight, p, z, strict=True)) + ridge
        b = b + 0.5 * np.linalg.solve(hessian + 1e-9 * np.eye(len(b)), gradient)
    return lambda v: np.clip(np.hstack([(v - mean) / scale, np.ones((len(v), 1))]) @ b, -30, 30), b, mean, scale


def plain_cotraining(text, meta, y, score_text, score_meta, counts, rounds=5, share=0.05, sure=0.95):
    """Co-training by its definition, with lists and loops; scores of the last two arrays."""
    known = [i for i in range(len(y)) if y[i] >= 0]
    check = known[2::3]
    base = [i for i in known if i not in check]
    pool = [i for i in range(len(y)) if y[i] < 0]
    stands = {k: counts[k] / sum(v == k for v in y) for k in (0, 1)}
    total = sum(stands[y[i]] for i in known)
    rate = sum(stands[y[i]] * y[i] for i in known) / total
    own = {i: stands[y[i]] * len(known) / total for i in known}
    views, given = (text, meta), ({}, {})

    def fit(v):
        rows = [*base, *sorted(given[v])]
        target = np.array([y[i] if y[i] >= 0 else given[v][i] for i in rows], float)
        return plain_logistic(views[v][rows], target, 2.0, np.array([1.0] * len(base) + [0.3] * len(given[v])))[0]

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        most = int(len(pool) * share / 2)
        for v in (0, 1):
            free = [i for i in pool if i not in given[1 - v]]
            if not free or not most:
                continue
            p = 1 / (1 + np.exp(-models[v](views[v][free])))
            by = sorted(range(len(free)), key=lambda i: p[i])
            given[1 - v].update({free[i]: 0.0 for i in by[:most] if p[i] <= 1 - sure})
            given[1 - v].update({free[i]: 1.0 for i in by[-most:] if p[i] >= sure})
        models = [fit(0), fit(1)]
    odds = -np.log(rate / (1 - rate))
    for v, new in enumerate((score_text, score_meta)):
        z = models[v](views[v][check])[:, None]
        at, b, _, scale = plain_logistic(z, np.array([y[i] for i in check], float), 1.0, np.array([own[i] for i in check]))
        odds = odds + (at(models[v](new)[:, None]) if b[0] > 0 else np.log(rate / (1 - rate)))
    return 1 / (1 + np.exp(-odds))


def test_scores_are_those_of_a_plain_co_training(spark):
    """The operator from tables to scores, against a version of lists and loops."""
    import random
    import zlib

    from conftest_llm import make_documents, prose

    rng = random.Random(11)
    rows = []
    for i in range(240):
        good = i % 3 > 0
        text = prose(rng, rng.randint(20, 60)) if good else " ".join(rng.choice(["XX9", "a", "!!", "##", "lo"]) for _ in range(rng.randint(5, 40)))
        if rng.random() < 0.15:
            text = prose(rng, 15) + "!"
        source = rng.choice(["s1", "s2", "s3"]) if good else rng.choice(["s3", "s4"])
        rows.append((i, text, "en" if i % 2 else None, f"rare{i}" if i % 17 == 0 else source))
    label = {i: int(i % 3 > 0) for i in range(120)}
    docs, labels = make_documents(spark, rows), spark.createDataFrame(list(label.items()), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in Q.quality(docs, Q.learn(docs, labels)).collect()}

    order = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text, lang, source, n_chars) as h").collect()}
    train = sorted(rows, key=lambda r: order[r[0]])
    langs, sources = [r[2] for r in train], [r[3] for r in train]
    own = {v for v in set(langs) | set(sources) if v is not None and max(langs.count(v), sources.count(v)) >= Q.NAMED}

    def metadata(r):
        out = []
        for v, among in ((r[2], langs), (r[3], sources)):
            names = sorted({x for x in among if x in own})
            other = None if v is None or v in names else zlib.crc32(v.encode()) % Q._OTHERS
            out += [float(v == x) for x in names] + [float(other == k) for k in range(Q._OTHERS)] + [float(v is None)]
        size = 1 + min(Q._SIZES - 2, len(bin(len(r[1]))[2:]) // 2)
        return out + [float(size == k) for k in range(Q._SIZES)]

    text, meta = np.array([plain_features(r[1]) for r in train]), np.array([metadata(r) for r in train])
    y = [label.get(r[0], -1) for r in train]
    want = plain_cotraining(text, meta, y, text, meta, {0: y.count(0), 1: y.count(1)})
    assert np.allclose(want, [got[r[0]] for r in train], atol=1e-4)
    assert 0.05 < np.mean(want) < 0.95


def test_the_sample_bounds_rows_and_not_ids(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("1L as doc_id", "concat('word ', id) as text").unionAll(spark.range(2, 60).selectExpr("id as doc_id", "concat('text ', id) as text"))
    labels = spark.range(1, 60).selectExpr("id as doc_id", "int(id > 1) as quality")
    sizes = []
    monkeypatch.setattr(Q, "cotrain", lambda x, m, y, **_: sizes.append((len(y), len(x), len(m))))
    Q.learn(docs, labels, sample=12)
    assert sizes and max(sizes[0]) <= 24
