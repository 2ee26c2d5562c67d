import hashlib
import random
import re
from collections import defaultdict

import numpy as np
from conftest_llm import EDGE, make_documents, prose

from sparrowdex.llm.mixing import STRATA, Targets, calibrate, cell_probabilities, mix, rake


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    index = np.array([[i, j, k] for i in range(4) for j in range(3) for k in range(2)])
    tokens = rng.integers(1, 1000, len(index))
    want = [rng.dirichlet(np.ones(n)) * 100 for n in (4, 3, 2)]
    w = rake(index, tokens, want)
    for axis, m in enumerate(want):
        assert np.allclose(np.bincount(index[:, axis], weights=w), m)
    # raking keeps the odds ratios of the tokens
    a, b, c, d = (index.tolist().index(x) for x in ([0, 0, 0], [0, 1, 0], [1, 0, 0], [1, 1, 0]))
    assert np.isclose(w[a] * w[d] / (w[b] * w[c]), tokens[a] * tokens[d] / (tokens[b] * tokens[c]))


def test_probabilities_sample_the_budget():
    tokens = np.array([100.0, 1000, 10])
    p = calibrate(np.array([0.6, 0.3, 0.1]), tokens, 500)
    assert np.isclose((p * tokens).sum(), 500)
    assert p.max() <= 1
    assert np.allclose(calibrate(np.array([0.6, 0.3, 0.1]), tokens, 5000), 1)


def brute(rows, targets):
    """{(id, text): (source, language, topic, tokens, sampled)} by plain Python."""
    import zlib

    def stratum(v, axis):
        if v is None:
            return "#null"
        return v if v in targets.weights.get(axis, {}) else f"#{zlib.crc32(v.encode()) % STRATA}"

    def topic(t):
        if any(m in t for m in ("def ", "return ", "#include", "public class", "function(")) and any(m in t for m in ("{", "():", ";\n")):
            return "code"
        if any(m in t for m in ("License", "license", "Copyright", "copyright")):
            return "license"
        return "link" if "http://" in t or "https://" in t else "contact" if "@" in t else "prose"

    out, cells = {}, defaultdict(lambda: [0, 0])
    for i, t, lang, source in rows:
        t = t or ""
        cell = (stratum(source, "source"), stratum(lang, "language"), topic(t))
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        cells[cell][0] += n
        cells[cell][1] += 1
        u = int(hashlib.md5(f"mix:{'null' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
        out[i, t, lang, source] = (cell, n, u)
    p = {c[:3]: c[4] for c in cell_probabilities([(*k, *v) for k, v in cells.items()], targets)}
    return {k: (*cell, n, u < p[cell]) for k, (cell, n, u) in out.items()}


def check(df, rows, targets):
    got = mix(df, targets).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.text or "", r.lang, r.source): (r.mix_source, r.mix_language, r.mix_topic, r.mix_tokens, r.mix_sampled) for r in got} == brute(rows, targets)


def test_edges(spark, edge, nothing):
    check(edge, EDGE, Targets())
    check(edge, EDGE, Targets(weights={"source": {"src0": 1.0, "absent": 2.0}, "language": {"en": 0.0}}))
    assert mix(nothing).count() == 0
    assert set(edge.columns) <= set(mix(edge).columns)


def test_a_hot_source_is_brought_to_its_target(spark):
    rng = random.Random(6)
    marks = ["", " see https://example.org", " a@example.org", " Copyright 2024"]
    rows = [(i, prose(rng, rng.randint(5, 80)) + rng.choice(marks), rng.choice(["en", "de"]), "src0" if i % 3 else f"src{i % 7}") for i in range(4000)]
    targets = Targets(weights={"source": {f"src{k}": 1.0 for k in range(7)}, "language": {"en": 0.5, "de": 0.5}}, budget=0.2)
    df = make_documents(spark, rows)
    check(df, rows, targets)
    kept = [r for r in mix(df, targets).collect() if r.mix_sampled]
    total = sum(r.mix_tokens for r in kept)
    for k in range(7):
        assert abs(sum(r.mix_tokens for r in kept if r.source == f"src{k}") / total - 1 / 7) < 0.03
    assert abs(total / sum(len(t.split()) for _, t, *_ in rows) - 0.2) < 0.02


def test_sources_whose_hashes_collide_are_strata_of_their_own(spark, tmp_path):
    import zlib

    from sparrowdex.llm.queries import op9_mixing_sources

    seen = {}
    for k in range(1000):
        name = f"site{k}"
        if (other := seen.setdefault(zlib.crc32(name.encode()) % STRATA, name)) != name:
            break
    rng = random.Random(3)
    rows = [(i, prose(rng, 20), "en", [other, other, other, name, None, "#null"][i % 6]) for i in range(600)]
    make_documents(spark, rows, clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_mixing_sources(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {(r.source, r.mix_source) for r in got} == {(other, other), (name, name), (None, "#null"), ("#null", "##null")}
    # the small source is sampled at a higher rate than the one whose hash it shares
    rate = {r.mix_source: r.mix_probability for r in got}
    assert rate[name] > rate[other]


def test_cells_raked_in_spark_have_the_weights_of_the_driver(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 30)) + rng.choice(["", " a@example.org"]), rng.choice(["en", "de", None]), f"s{rng.randint(0, 300) % rng.choice([3, 301])}") for i in range(1500)]
    targets = Targets(weights={"source": {"s0": 0.3, "s1": 0.0}, "language": {"en": 0.2}}, budget=0.4, rounds=3, hashed=False)
    df = make_documents(spark, rows)
    keys = ("mix_source", "mix_language", "mix_topic")
    here, there = ({tuple(r[k] for k in keys): (r.mix_weight, r.mix_probability) for r in mix(df, targets, driver_cells=n).collect()} for n in (10**6, 0))
    assert here.keys() == there.keys()
    assert all(np.allclose(here[k], there[k], rtol=1e-6, atol=1e-12) for k in here)


def test_the_report_is_the_mix_without_texts(spark, edge, nothing):
    from sparrowdex.llm.mixing import PRODUCTION, mix, mixing_report

    for docs in (edge, edge.withColumn("mix_tokens", edge["n_chars"]), edge.drop("lang", "source"), nothing):
        got = mixing_report(docs)
        want = mix(docs, PRODUCTION)
        both = [c for c in got.columns if c in want.columns]
        assert sorted(map(str, got.select(both).collect())) == sorted(map(str, want.select(both).collect()))


def test_stated_weights_are_met(spark):
    """Expected tokens of the sample have the languages' and topics' weights where no probability is cut at 1."""
    import random

    from conftest_llm import make_documents, prose

    from sparrowdex.llm.mixing import Targets, mixing_report

    rng = random.Random(6)
    texts = lambda: prose(rng, rng.randint(20, 80)) + rng.choice(["", " see http://a.b", " License"])
    docs = make_documents(spark, [(i, texts(), rng.choice(["en", "en", "en", "de"]), rng.choice(["a", "a", "b"])) for i in range(3000)])
    weights = {"language": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.6, "link": 0.3, "license": 0.1}}
    rows = mixing_report(docs, Targets(weights=weights, flat=(1.0, 1.0, 1.0), budget=0.1, hashed=False)).collect()
    expected = {}
    for r in rows:
        for axis, value in (("language", r.mix_language), ("topic", r.mix_topic), ("source", r.mix_source)):
            expected[axis, value] = expected.get((axis, value), 0) + r.mix_probability * r.mix_tokens
    total = sum(r.mix_tokens for r in rows)
    for axis, want in weights.items():
        for value, share in want.items():
            assert abs(expected[axis, value] / (0.1 * total) - share) < 1e-3, (axis, value)
    own = sum(r.mix_tokens for r in rows if r.source == "a") / total
    assert abs(expected["source", "a"] / (0.1 * total) - own) < 1e-3
