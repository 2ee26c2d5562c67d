import random
import re

from conftest_llm import EDGE, make_documents, prose

from sparrowdex.llm.licenses import PHRASES, TEMPLATES, license_scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words(text)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "x under the MIT License under the mit license y", "CC BY-NC 4.0 and CC-BY-NC", "apache license version 20", "under the\nmit\tlicense", "UNDER THE MIT LICENSE", "under the mit-license, apache-license/version.2!", "cc by", "ünder the mit license é", "by nc cc by nc nc",
]


def test_base_places(spark, edge, nothing):
    rows = [(100 + i, t, "en", "s") for i, t in enumerate(TEXTS)]
    rng = random.Random(3)
    rows += [(200 + i, " ".join(rng.choice([*PHRASES, "mit", "under", "the", "license", "cc", "by", prose(rng, 2)]) for _ in range(60)), "en", "s") for i in range(40)]
    for r in license_scan(make_documents(spark, rows)).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert base(r) == brute(text), text
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
    got = sorted((str(r.doc_id), base(r)) for r in license_scan(edge).collect())
    assert str(got) == str(sorted((str(i), brute(t)) for i, t, *_ in EDGE))
    assert license_scan(nothing).count() == 0


def test_every_template_is_found_amid_prose_and_after_an_edit(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for label, text in TEMPLATES:
        w = text.split()
        for edited in ([False, True] if len(w) > 20 else [False]):
            body = list(w)
            if edited:
                body.insert(len(w) // 2, "verily")
                del body[len(w) // 4]
            rows.append((len(rows), f"{prose(rng, 50)} {' '.join(body)} {prose(rng, 50)}", "en", "s"))
            want[len(rows) - 1] = label
    for r in license_scan(make_documents(spark, rows)).collect():
        assert want[r.doc_id] in r.labels.split(","), rows[r.doc_id]
        assert r.score >= 0.8
        start = next(s.start for s in r.spans if s.label == want[r.doc_id])
        assert abs(start - 50) <= 3


def test_a_template_within_another_license_is_not_its_label(spark):
    rows = [(1, "licensed under the GNU Lesser General Public License, version 3", "en", "s"), (2, "we are licensed under the law of the land", "en", "s"), (3, "licensed under CC BY-NC 4.0", "en", "s"), (4, "mit license mit license", "en", "s")]
    got = {r.doc_id: r.labels for r in license_scan(make_documents(spark, rows)).collect()}
    assert got == {1: "lgpl-3", 2: "", 3: "cc-by-nc", 4: ""}


def test_many_repeats_in_one_text(spark):
    text = "licensed under the MIT License " * 500
    (r,) = license_scan(make_documents(spark, [(1, text, "en", "s")])).collect()
    assert (r.n_base, r.labels, len(r.spans)) == (500, "mit", 500)
