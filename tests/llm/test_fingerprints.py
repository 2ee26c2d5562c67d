import hashlib
import random
import re

import numpy as np
from conftest_llm import EDGE, make_documents, prose

from sparrowdex.llm import common as C
from sparrowdex.llm import fingerprints as P


def sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def order(rows):
    """Rows by descending id, null ids last; equal ids in any order."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_edited_texts_and_followers(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, prose(rng, rng.randint(0, 120)) + rng.choice(["", " é日👍"]), "en", "s") for i in range(200)]
    got = {r.doc_id: r for r in P.document_fingerprints(make_documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    ranked = order(rows)
    errors = []
    for (i, text, *_), (_, after, *_) in zip(ranked, ranked[1:] + ranked[:1], strict=True):
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = sets(text), sets(edited)
        if len(a) > 20:
            errors.append(got[i].near_edited - len(a & b) / len(a | b))
        assert 0 <= got[i].near_next <= 1
    assert abs(np.mean(errors)) < 0.02
    assert np.abs(errors).max() < 0.2


def test_equal_texts_have_equal_fingerprints(spark, edge, nothing):
    out = P.document_fingerprints(edge).collect()
    assert len(out) == len(EDGE)
    same = {r.fingerprint for r in out if r.n_chars == len("the same text here for all of them")}
    assert len(same) == 1
    assert {r.fingerprint for r in out if r.n_chars == 0} == {""}
    assert P.document_fingerprints(nothing).count() == 0


def test_a_single_document_is_followed_by_itself(spark):
    (r,) = P.document_fingerprints(make_documents(spark, [(5, "one two three four five six seven", "en", "s")])).collect()
    assert r.near_next == 1.0


def test_likeness_is_unbiased_for_few_and_many_shingles():
    rng = random.Random(8)
    for n in (12, 60, 400, 3000):
        errors = []
        for _ in range(40):
            words = [f"w{rng.random()}" for _ in range(n)]
            other = words[: n // 2] + [f"v{rng.random()}" for _ in range(n // 2)]
            a, b = sets(" ".join(words)), sets(" ".join(other))
            x, y = (P.fingerprint(C.word_hashes(" ".join(w).encode())[0]) for w in (words, other))
            errors.append(P.likeness(x, y) - len(a & b) / len(a | b))
        assert abs(np.mean(errors)) < 0.03
