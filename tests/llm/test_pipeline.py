from collections import Counter

import corpus_pipeline
from test_near_duplicates import brute

from sparrowdex.llm import common as C
from sparrowdex.llm import quality, toxicity
from sparrowdex.llm.queries import ORACLE_SQL, QUERIES, training_labels

SF = "/root/testdata/sf0.01"


def test_each_stage_does_its_part_of_the_work(spark):
    docs = C.cut(C.read(spark, SF, "documents"), "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {}
    last = docs
    for name, stage in corpus_pipeline.STAGES:
        out = C.cut(stage(spark, last, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            got = {r.doc_id: r for r in out.collect()}
            assert all(rows[i] == r for i, r in got.items())
        kept[name] = (last, out)
        last = out
    names = [n for n, _ in corpus_pipeline.STAGES]

    before, after = kept[names[0]]
    scores = quality.quality(before, quality.learn(before, training_labels(spark, SF))).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores if r.score >= 0.5}

    before, after = kept[names[1]]
    scores = toxicity.toxicity(before, toxicity.learn(before, training_labels(spark, SF))).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores if r.score < 0.7}

    before, after = kept[names[2]]
    pairs = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    assert {r.doc_id for r in after.collect()} == {i for i, _, low in brute(pairs, 5, 80, 100) if i == low}

    before, after = kept[names[3]]
    assert 0.5 < after.count() / before.count() < 0.9

    before, after = kept[names[4]]
    out = after.collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in before.collect()}
    least = -(-sum(r.length for r in out) // 4096)  # whether that many can hold them is another question
    assert least <= len({r.sequence_id for r in out}) <= 1.01 * least + 1
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()}
    assert whole == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out}


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_on_edges(spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge, nothing):
            out = stage(spark, docs, SF)
            n = out.count()
            if name == corpus_pipeline.STAGES[-1][0]:
                assert n >= docs.count()
            else:
                assert out.columns == docs.columns
                assert n <= docs.count()
                assert out.schema == docs.schema
                assert not Counter(map(repr, out.collect())) - Counter(map(repr, docs.collect()))


def test_the_pipeline_leaves_its_result_only(spark):
    before = C.made()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert C.made() - before == {out._sparrowdex_path}
    assert out.count() > 0
