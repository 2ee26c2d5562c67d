import random

import pytest
from conftest_llm import EDGE, make_documents, prose

from sparrowdex.llm import common as C
from sparrowdex.llm import toxicity as X
from sparrowdex.llm.queries import op1_toxicity


def test_folding_undoes_disguises():
    lexicon = X.Lexicon.fixed()
    for text in ("idiot", "IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "ídïöt", "id​iot", "an idiot.", "(idiot)", "st­upid", "$tup1d", "l0ser", "1oser"):
        assert X.hits(lexicon, X.fold(text))[1] == 1, text
    for text in ("", "  ", "video", "losing", "an idea", "100 300", "kidiot"):
        assert X.hits(lexicon, X.fold(text))[1] == 0, text


def test_exception_phrases_spare_their_words_only():
    lexicon = X.Lexicon.fixed()
    assert X.hits(lexicon, X.fold("an idiot-proof trash can"))[1] == 0
    assert X.hits(lexicon, X.fold("idiot proof idiot"))[1] == 1
    assert X.hits(lexicon, X.fold("trash can trash can trash"))[1] == 1


def brute(lexicon, text):
    """Weights of the words that begin with an entry, outside exception phrases."""
    w = X.fold(text).split()
    spared = {i + k for x in lexicon.exceptions for i in range(len(w)) if w[i : i + len(x.split())] == x.split() for k in range(len(x.split()))}
    found = [max((weight for key, weight in lexicon.entries if x.startswith(key[1:])), default=0) for i, x in enumerate(w) if i not in spared]
    return sum(found), sum(x > 0 for x in found)


def test_hits_are_those_of_brute_force():
    rng, lexicon = random.Random(1), X.Lexicon.fixed()
    parts = [*X.WORDS, *X.EXCEPTIONS, "idiots", "a", "proof", "can", "trashy", "1d10t"]
    for _ in range(500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert X.hits(lexicon, X.fold(text)) == pytest.approx(brute(lexicon, text)), text


def test_edges(spark, edge, nothing):
    out = X.toxicity(edge, X.Lexicon.fixed()).collect()
    assert len(out) == len(EDGE)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert not any(r.predicted for r in out)
    assert X.toxicity(nothing, X.Lexicon.fixed()).count() == 0
    left = X.without_toxic(edge, X.Lexicon.fixed())
    assert left.columns == edge.columns
    assert left.count() == len(EDGE)


def test_learning_without_labels_gives_the_fixed_lexicon(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.learn(edge, none) == X.Lexicon.fixed()
    some = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert X.learn(edge, some) == X.Lexicon.fixed()


def test_held_out_rows_of_another_language(spark):
    """Word beginnings that only labels show to be toxic are found in rows whose labels were not seen."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, rng.randint(20, 300)).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), "zugor" + rng.choice(["", "en", "heit", "ka"]))
        if not toxic and i % 50 == 1:
            w.append("zugotan")
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    docs, known = make_documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    lexicon = X.learn(docs, known.where(~C.held_out(F.col("doc_id"))))
    out = X.toxicity(docs, lexicon).withColumn("held_out", C.held_out(F.col("doc_id"))).where("held_out").collect()
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in out)
    assert len(out) > 200
    assert right >= 0.99 * len(out)


def test_held_out_rows_of_the_supplied_table(spark):
    out = op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted for r in out if not r.toxic) <= 0.005 * len(out)
    toxic = [r for r in out if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic)


def test_a_bounded_sample_is_weighted_back(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + (" zorgblat" * 3 if i % 20 == 0 else ""), "en", "src0") for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(800)], "doc_id long, toxic int")
    docs = make_documents(spark, rows)
    scores = {r.doc_id: r.score for r in X.toxicity(docs, X.learn(docs, labels, sample=90)).collect()}
    assert abs(np.mean([s for i, s in scores.items() if i % 20]) - 40 / 760) < 0.04


def test_the_sample_bounds_rows_and_not_ids(spark, monkeypatch):
    from sparrowdex.llm import common

    docs = spark.range(30_000).selectExpr("1L as doc_id", "concat('word ', id, ' of one id') as text").unionAll(spark.range(2, 60).selectExpr("id as doc_id", "concat('zugor text ', id) as text"))
    labels = spark.range(1, 60).selectExpr("id as doc_id", "int(id > 1) as toxic")
    sizes = []
    cut = common.cut

    def counted(df, name, *rest):
        out = cut(df, name, *rest)
        if name == "labelled":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(common, "cut", counted)
    X.learn(docs, labels, sample=12)
    assert sizes and max(sizes) <= 12


def test_equal_texts_are_toxic_if_any_label_says_so(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + (" zugor" * 3 if i % 4 == 0 else ""), "en", "s") for i in range(200)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    copies = [(i + 1000, t, "en", "s") for i, t, *_ in rows if i % 4 == 0]
    once = X.learn(make_documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    both = X.learn(make_documents(spark, rows + copies), spark.createDataFrame(labels + [(i, 1, 0) for i, *_ in copies], "doc_id long, quality int, toxic int"))
    assert once == both


def test_entries_are_whole_words_of_any_length_or_beginnings():
    long = " " + "a" * 40 + " "
    counts = [(long, 20, 0), (" aaaa", 20, 0), (" chance ", 4, 3), (" often", 40, 2), (" oftenest ", 10, 0), (" rare ", 3, 0)]
    got = X.entries(counts, 100, 900)
    assert set(got) == {long, " often", " oftenest "}  # the beginning of the long word is implied by it
    assert got[" often"] < 6.0
