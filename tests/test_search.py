import json
import math
import types

import pytest
from pyspark.sql import functions as F

from sparrowdex.functions import text as T
from sparrowdex.operators import bundles as B
from sparrowdex.operators import contract, evaluation, index, parsing
from sparrowdex.operators import rules as R
from sparrowdex.operators.chunking import chunk
from sparrowdex.operators.profile import profile
from sparrowdex.plans import default_rules as D
from sparrowdex.plans import engine, rendering

FILES = {
    "docs/apis/settings.md": "# Settings API\n\nThe settings page is defined in `db/settings.php` and in admin/tool.php for every plugin.\n\n## Adding settings\n\nAdd a setting with a name and a default value; the value is stored in the database table.\n\n## Reading settings\n\nRead the configuration with a call that returns the stored value or the default value.",
    "docs/guides/license.md": "# License guide\n\nThe code is licensed under the terms that the license file names; see license.md for them.\n\n## Copyright\n\nEvery file names the holder of the copyright and the year of the first release.",
    "versioned_docs/version-4.1/docs/apis/settings.md": "# Settings API\n\nThe settings page is defined in `db/settings.php` and in admin/tool.php for every plugin.",
    "docs/render.md": "# Render flow\n\nThe renderer takes a renderable and a template; the output of the template is the page that is shown.\n\n## Examples\n\nAn example of a template with a heading and a list is in mytemplate.mustache below.",
}


@pytest.fixture(scope="module")
def chunks(spark):
    files = spark.createDataFrame([(p, t, None) for p, t in FILES.items()], "source_path string, raw string, modified timestamp")
    return engine.kept(chunk(*parsing.markdown(files)))


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, raw_query string")


def test_profiles(spark):
    texts = ["Where is the Settings page defined?", "settings", "the", "", None, "change files under db/access and lib/x.php", "what happens when docs are indexed", "How do I write a test"]
    p = {r.qid: r for r in profile(asked(spark, *texts)).collect()}
    assert p["q0"].tokens == ["settings", "page", "defined"]
    assert p["q0"].expanded == ["settings", "setting", "page", "defined"]
    assert p["q0"].phrases == ["settings page defined", "settings page", "page defined"]
    assert (p["q0"].intent, p["q0"].task, p["q0"].families) == ("conceptual", "file_location", ["configuration"])
    assert (p["q1"].intent, p["q1"].task, p["q1"].phrases) == ("keyword", "general", [])
    assert (p["q2"].tokens, p["q2"].normalized) == (["the"], "the")
    assert (p["q3"].tokens, p["q3"].normalized, p["q4"].tokens) == ([], "", [])
    assert (p["q5"].file_hints, p["q5"].subtree_hints, p["q5"].task) == (["lib/x.php"], ["db/access"], "implementation_guide")
    assert "documentation" in p["q6"].expanded
    assert (p["q6"].task, p["q7"].task) == ("flow_explainer", "implementation_guide")


def test_bm25_is_that_of_a_plain_loop(spark, chunks):
    p = profile(asked(spark, "settings page defined", "stored value", "license"))
    plan = index.plans(p, F.col("tokens"), F.col("expanded"), F.col("normalized"))
    got = {(r.qid, r["pass"], r.chunk_id): r.score for r in index.bm25(index.build(chunks), plan).collect()}
    docs = {r.id: [r.content, r.metadata.source_path, r.metadata.document_title, " > ".join(r.metadata.heading_path)] for r in chunks.collect()}
    import re

    words = {i: [re.findall(r"[^\W_]+", f.lower()) for f in fields] for i, fields in docs.items()}
    size = {i: sum(map(len, w)) for i, w in words.items()}
    mean = sum(size.values()) / len(size)

    def places(i, phrase):
        return sum(f[k : k + len(phrase)] == phrase for f in words[i] for k in range(len(f)))

    want = {}
    for q in p.collect():
        passes = [(1, q.tokens, len(q.tokens))] + ([(2, [q.normalized], 1), (3, q.expanded, 1)] if len(q.tokens) > 1 else [])
        for number, phrases, needed in passes:
            for i in docs:
                total, held = 0.0, 0
                for x in phrases:
                    tf = places(i, x.split())
                    df = sum(places(j, x.split()) > 0 for j in docs)
                    if tf:
                        held += 1
                        idf = math.log((len(docs) - df + 0.5) / (df + 0.5))
                        total += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean))
                if held >= needed:
                    want[q.qid, number, i] = -total
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_results_are_ranked_once_each_and_explained(spark, chunks):
    results, _ = engine.search(asked(spark, "where is the settings page defined", "license", "nothing matches xyzzy", ""), chunks, 3)
    rows = sorted(results.collect(), key=lambda r: (r.qid, r.rank))
    assert {r.qid for r in rows} == {"q0", "q1", "q2"} - ({"q2"} if not any(r.qid == "q2" for r in rows) else set())
    first = rows[0]
    assert first.source_path == "docs/apis/settings.md"
    keys = [(r.qid, r.source_path.replace("versioned_docs/version-4.1/", ""), tuple(r.heading_path)) for r in rows]
    assert len(keys) == len(set(keys))  # the versioned copy is folded into its page
    assert [r.rank for r in rows if r.qid == "q0"] == [1, 2, 3]
    b = first.breakdown.asDict()
    from sparrowdex.operators.rerank import ADDED

    total = b["lexical_score"] + sum(b[k] * w for k, w in D.WEIGHTS.items()) + sum(b[k] for k in ADDED)
    assert abs(total - b["weighted_score"]) < 0.01
    assert len(b) == 27
    with pytest.raises(ValueError, match="top_k"):
        engine.search(asked(spark, "x"), chunks, 0)


def test_file_hints_move_results(spark, chunks):
    results, _ = engine.search(asked(spark, "which file should I change, db/settings.php or admin/tool.php, for settings"), chunks, 5)
    best = min(results.collect(), key=lambda r: r.rank)
    assert best.breakdown.anchor_bonus >= 2 * D.ANCHORS["file"]
    assert "db/settings.php" in best.content


def test_rules(spark):
    rows = spark.createDataFrame([("docs/Example.md", ["a", "b"], 5)], "p string, t array<string>, n int")
    rules = [{"group": 1, "add": 3, "when": [("p", "contains", ["nope", "example"])]}, {"group": 1, "add": 9, "when": []}, {"add": -1, "when": [("t", "has all", ["a", "b"]), ("n", "over", 4), ("p", "not ends", ".txt")]}, {"add": 100, "when": [("t", "lacks", ["a"])]}]
    assert rows.select(R.total(rules)).head()[0] == 2.0
    assert rows.select(R.first([{"label": "x", "when": [("n", "under", 5)]}, {"label": "y", "when": [("p", "matches", "^docs/")]}], "z")).head()[0] == "y"
    assert rows.select(R.labels([{"label": "x", "when": [("p", "starts", "docs")]}, {"label": "y", "when": [("p", "is", "q")]}])).head()[0] == ["x"]


def test_snippets(spark):
    text = " ".join(f"w{i}" for i in range(50)) + " Needle and needle hay " + " ".join(f"v{i}" for i in range(50))
    got = spark.createDataFrame([(text,), ("",), ("needle",)], "c string").select(index.snippet(F.col("c"), F.array(F.lit("needle"), F.lit("hay")))).collect()
    assert "[Needle] and [needle] [hay]" in got[0][0]
    assert got[0][0].startswith("...")
    assert [r[0] for r in got[1:]] == ["", "[needle]"]


def long_section(spark):
    body = "\n\n".join(f"Paragraph {i} " + "with some words to fill it up to a size of its own " * 3 for i in range(9))
    files = spark.createDataFrame([("docs/long.md", f"# Long page\n\n{body}", None)], "source_path string, raw string, modified timestamp")
    c = chunk(*parsing.markdown(files), max_tokens=60, overlap_tokens=0)
    return engine.kept(c)


def test_bundles_grow_on_both_sides_while_there_is_room(spark):
    chunks = long_section(spark)
    rows = sorted(chunks.collect(), key=lambda r: r.chunk_order)
    size = [len_compact(r.content) for r in rows]
    results, p = (engine.kept(x) for x in engine.search(asked(spark, "paragraph 4"), chunks, 1))
    (best,) = results.collect()
    at = best.chunk_order
    for budget, sides in ((rows[at].token_count, [(True, True)]), (130, [(True, True)]), (200, [(True, True), (True, False), (False, True), (False, False)]), (10_000, [(True, True)])):
        for before, after in sides:
            (b,) = B.bundles(results, p, chunks, before, after, budget).collect()
            total, left, right = rows[at].token_count, [], []
            for d in range(1, len(rows)):
                added = False
                for side, ok, held in ((at - d, before, left), (at + d, after, right)):
                    if ok and 0 <= side < len(rows) and total < budget + 10**9 and budget > rows[at].token_count and total + size[side] <= budget:
                        total += size[side]
                        held.append(side)
                        added = True
                if not added:
                    break
            want = [*reversed(left), at, *right]
            assert [c.chunk_id for c in b.chunks] == [rows[i].id for i in want], (budget, before, after)
            assert b.bundle_token_count == total
            assert b.selection_strategy == ("section_window" if len(want) > 1 else "match_only")
    (b,) = B.bundles(results, p, chunks, True, True, 20).collect()
    assert (b.selection_strategy, b.bundle_token_count <= 20, b.diagnostics.truncated) == ("truncated_match", True, True)


def len_compact(content):
    import regex

    c = content.split("\n\n", 1)[1].strip() if content.startswith("Heading: ") else content
    return len(regex.findall(T.PIECE, c))


def test_a_support_chunk_is_added_trims_or_is_rejected(spark, chunks):
    q = asked(spark, "how do I write a license file")
    results, p = (engine.kept(x) for x in engine.search(q, chunks, 3))
    rules = types.SimpleNamespace(**{k: getattr(D, k) for k in dir(D) if k.isupper()})
    (b,) = B.bundles(results.where("rank = 1"), p, chunks, max_tokens=600, rules=rules).collect()
    assert b.diagnostics.support_reason == "implementation_guide"
    assert (b.selection_strategy, b.chunks[-1].role, b.diagnostics.support_added) == ("task_support", "support", True)
    rules.SUPPORT = [{"add": -1000, "when": []}]
    (b,) = B.bundles(results.where("rank = 1"), p, chunks, max_tokens=600, rules=rules).collect()
    assert (b.selection_strategy, b.diagnostics.support_added, b.diagnostics.support_rejected) == ("match_only", False, "no_candidate")
    tight = b.bundle_token_count + 5
    (b,) = B.bundles(results.where("rank = 1"), p, chunks, max_tokens=tight).collect()
    assert (b.diagnostics.support_added, b.diagnostics.support_rejected) == (False, "budget")


def test_contracts(spark, chunks):
    q = asked(spark, "where is the settings page defined", "zzz qqq")
    e = engine.contracts(q, chunks, 3)
    assert contract.violations(e).count() == 0
    out = {r.qid: json.loads(r.json) for r in contract.as_json(e).collect()}
    assert out["q1"]["results"] == []
    c = out["q0"]
    assert (c["version"], c["query"], c["normalized_query"]) == ("v1", "where is the settings page defined", "settings page defined")
    assert [r["rank"] for r in c["results"]] == [1, 2, 3]
    assert [r["confidence"] for r in c["results"]] == ["high", "medium", "medium"]
    first = c["results"][0]
    assert first["source"]["url"] is None
    assert first["content"]["file_anchors"][0] in ("db/settings.php", "admin/tool.php")
    assert first["content"]["summary"].startswith("Settings API — ")
    assert first["diagnostics"]["ranking_explanation"].startswith("Rank 1 devdocs_repo bundle from Settings API")
    assert all(len(p) >= 20 for p in first["content"]["key_points"])
    broken = e.withColumn("results", F.transform("results", lambda r: r.withField("confidence", F.lit("sure")).withField("rank", r["rank"] + 1)))
    assert {r.problem for r in contract.violations(broken).collect()} == {"confidence is unknown", "ranks aren't gapless"}


def cases(spark, *rows):
    import pyspark.sql.types as st

    schema = spark.createDataFrame([], evaluation.CASE).schema
    assert isinstance(schema, st.StructType)
    return evaluation.with_defaults(spark.createDataFrame([tuple({"query": "q", **r}.get(f) for f in schema.names) for r in rows], schema))


def result(qid, rank, path, source="s", heading=("H",), title="T", content="some text"):
    return (qid, rank, f"{qid}-{rank}", path, source, "web", title, None, list(heading), content)


RESULT = "qid string, rank int, chunk_id string, source_path string, source_name string, source_type string, document_title string, section_title string, heading_path array<string>, content string"


def test_grading(spark):
    c = cases(
        spark, {"id": "path", "bucket": "b1", "preferred_document_paths": ["Docs/A"]}, {"id": "weak", "bucket": "b1", "preferred_document_paths": ["zzz"], "acceptable_heading_substrings": ["deep"]}, {"id": "bad", "preferred_document_paths": ["docs"], "disallowed_document_paths": ["docs/a"]},
        {"id": "source", "preferred_source_names": ["S"], "acceptable_source_names": ["t"]}, {"id": "blocked", "preferred_source_names": ["other"], "preferred_document_paths": ["docs/a"]}, {"id": "none", "query_style": "x"}, {"id": "both", "preferred_source_names": ["s"], "preferred_heading_substrings": ["h"]},
    )
    r = [result("path", 1, "versioned_docs/version-1/x.md"), result("path", 2, "versioned_docs/version-1/docs/a.md"), result("weak", 1, "p", heading=("Deep", "x")), result("bad", 1, "docs/a.md"), result("source", 1, "p", "t"), result("source", 2, "p", "s"), result("blocked", 1, "docs/a.md"), result("both", 1, "x")]
    out = {x.case_id: x for x in evaluation.outcomes(c, spark.createDataFrame(r, RESULT)).collect()}
    got = {k: (x.grade, x.matched_result_rank, x.matched_rule_type) for k, x in out.items()}
    assert got == {"path": ("STRONG PASS", 2, "preferred_path"), "weak": ("WEAK PASS", 1, "acceptable_heading"), "bad": ("MISS", None, None), "source": ("WEAK PASS", 1, "acceptable_source"), "blocked": ("MISS", None, None), "none": ("MISS", None, None), "both": ("STRONG PASS", 1, "preferred_source+target")}
    assert out["none"].failure_summary == "The search found nothing."
    assert out["bad"].failure_summary.startswith("The first result is from a path that this case rules out: docs/a.md")
    assert out["blocked"].failure_summary.startswith("The first result is from s,")
    assert out["path"].ranking_diagnostic.startswith("A preferred result comes at rank 2")
    assert (out["path"].strong_pass_top_1, out["path"].strong_pass_top_3) == (False, True)
    assert out["both"].matched_on == ["preferred_source:s", "preferred_heading:h"]
    assert out["source"].preferred_source_rank is None  # names are compared as they are written

    o = evaluation.outcomes(c, spark.createDataFrame(r, RESULT))
    rep = evaluation.report(o)
    rows = {(x.dimension, x.label): x for x in rep.collect()}
    total = rows["overall", "all"]
    assert (total.total_queries, total.strong_passes, total.weak_passes, total.misses, total.top_1_strong_passes, total.top_3_strong_passes) == (7, 2, 2, 3, 1, 2)
    assert rows["bucket", "b1"].case_ids == ["path", "weak"]
    assert rows["bucket", "uncategorized"].total_queries == 5
    assert ("query_style", "uncategorized") not in rows
    assert evaluation.inconsistent(rep, o).count() == 0
    assert evaluation.inconsistent(rep.withColumn("misses", F.col("misses") + 1), o).count() > 0
    parts = rendering.sections(rep)
    assert "  strong_passes: 2" in rendering.text(parts)
    assert "| b1 | 2 | 1 | 1 | 0 |" in rendering.markdown(parts)
    assert evaluation.validation_status(rep).head().status == "NON_GREEN"
    assert {x.case_id for x in evaluation.source_confusions(o).collect()} == {"blocked"}

    worse = spark.createDataFrame([x for x in r if x[0] not in ("path",)] + [result("none", 1, "q")], RESULT)
    base = evaluation.outcomes(c, worse)
    status = {(x.dimension, x.label, x.metric_family): x.status for x in evaluation.comparison(rep, evaluation.report(base)).collect()}
    assert status["overall", "all", "retrieval"] == status["overall", "all", "all"] == "improved"
    assert status["bucket", "uncategorized", "retrieval"] == "unchanged"
    (change,) = evaluation.case_changes(o, base).collect()
    assert (change.case_id, change.retrieval_from, change.retrieval_to) == ("path", "MISS", "STRONG PASS")


def test_bundle_grades(spark):
    part = lambda path="docs/a.md", source="s", content="x": (f"{path}{content}", "match", content, 50, path, source, "web", None, None, None, ["H"])
    c = cases(
        spark, {"id": "fine", "preferred_document_paths": ["docs/a"]}, {"id": "miss"}, {"id": "heading", "required_heading_substrings_for_bundle": ["absent"]}, {"id": "over", "max_reasonable_bundle_tokens": 40}, {"id": "far", "max_reasonable_bundle_tokens": 20}, {"id": "path", "preferred_bundle_paths": ["other"]},
        {"id": "mixed"}, {"id": "mixed_ok", "allow_mixed_bundle_sources": True}, {"id": "redundant"}, {"id": "thin"}, {"id": "none"}, {"id": "source", "preferred_bundle_source_names": ["t"]}, {"id": "accept", "preferred_bundle_source_names": ["t"], "acceptable_bundle_source_names": ["s"]},
    )
    ids = [r.id for r in c.select("id").collect()]
    graded = spark.createDataFrame([(i, "MISS" if i == "miss" else "STRONG PASS") for i in ids], "case_id string, grade string")
    chunks = {"mixed": [part(), part(source="t", content="y")], "mixed_ok": [part(), part(source="t", content="y")], "redundant": [part(content="A  b"), part(content="a B")]}
    rows = [(i, 1, 30 if i == "thin" else 50, "docs/a.md", "s", "web", "T", None, ["H"], chunks.get(i, [part()]), "match_only") for i in ids if i != "none"]
    schema = "qid string, rank int, bundle_token_count int, source_path string, source_name string, source_type string, document_title string, section_title string, heading_path array<string>, chunks array<struct<chunk_id:string,role:string,content:string,token_count:int,source_path:string,source_name:string,source_type:string,source_url:string,canonical_url:string,section_title:string,heading_path:array<string>>>, selection_strategy string"
    got = {r.case_id: r for r in evaluation.grade_bundles(c, graded, spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.bundle_grade for k, r in got.items()} == {
        "fine": "COMPLETE", "miss": "INSUFFICIENT", "heading": "INSUFFICIENT", "over": "PARTIAL", "far": "INSUFFICIENT", "path": "PARTIAL", "mixed": "PARTIAL", "mixed_ok": "COMPLETE", "redundant": "PARTIAL", "thin": "PARTIAL", "none": "INSUFFICIENT", "source": "INSUFFICIENT", "accept": "PARTIAL",
    }
    assert got["none"].bundle_diagnostic == "there is no bundle"
    assert got["fine"].bundle_diagnostic == "a named path is in the bundle; the match is from s"
    assert "takes 50 tokens of 40" in got["over"].bundle_diagnostic


def test_evaluation_from_end_to_end(spark, chunks):
    c = cases(spark, {"id": "a", "query": "settings page", "preferred_document_paths": ["docs/apis/settings.md"]}, {"id": "b", "query": "copyright holder", "preferred_heading_substrings": ["copyright"], "top_k": 1})
    out = {r.case_id: r for r in engine.evaluate(c, chunks, with_bundles=True).collect()}
    assert {k: (r.grade, r.bundle_grade) for k, r in out.items()} == {k: ("STRONG PASS", "PARTIAL" if out[k].bundle_token_count < 40 else "COMPLETE") for k in ("a", "b")}  # small bundles are thin
