"""Graded retrieval and bundles: outcomes, grouped reports and comparison with a baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .wording import BUNDLES, FAILURES, MISS, RANKINGS, STRONG, WEAK, say

CASE = """id string, query string, bucket string, query_style string, concept_id string, description string, preferred_source_names array<string>, acceptable_source_names array<string>,
 preferred_document_paths array<string>, acceptable_document_paths array<string>, preferred_heading_substrings array<string>, acceptable_heading_substrings array<string>, disallowed_document_paths array<string>,
 preferred_bundle_paths array<string>, preferred_bundle_source_names array<string>, acceptable_bundle_source_names array<string>, preferred_heading_substrings_for_bundle array<string>,
 required_heading_substrings_for_bundle array<string>, allow_mixed_bundle_sources boolean, max_reasonable_bundle_tokens int, top_k int, notes string"""
_LISTS = (
    "preferred_source_names", "acceptable_source_names", "preferred_document_paths", "acceptable_document_paths", "preferred_heading_substrings", "acceptable_heading_substrings", "disallowed_document_paths",
    "preferred_bundle_paths", "preferred_bundle_source_names", "acceptable_bundle_source_names", "preferred_heading_substrings_for_bundle", "required_heading_substrings_for_bundle",
)
#: Metrics that are better when higher; of the others less is better.
HIGHER = ("strong_passes", "top_1_strong_pass_rate", "top_3_strong_pass_rate", "top_5_strong_pass_rate", "complete", "complete_rate")


def with_defaults(cases: DataFrame) -> DataFrame:
    """Cases with no null lists, mixed bundle sources not allowed and a top_k of 5 where unsaid; columns that are missing are added."""
    kinds = dict(x.rsplit(" ", 1) for x in (y.strip() for y in CASE.replace("\n", " ").split(",")))
    rows = cases.select(*((F.col(c) if c in cases.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()), *(c for c in cases.columns if c not in kinds))
    return rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in _LISTS} | {"allow_mixed_bundle_sources": F.coalesce("allow_mixed_bundle_sources", F.lit(False)), "top_k": F.coalesce("top_k", F.lit(5))})


def matching(needles: Column, *hay: Column) -> Column:
    """The needles that are somewhere in the hay, which is in lower case."""
    return F.filter(needles, lambda n: reduce(lambda a, b: a | b, (F.contains(F.coalesce(h, F.lit("")), F.lower(n)) for h in hay)))


def same(expected: Column, actual: Column) -> Column:
    return F.filter(expected, lambda e: F.coalesce(F.lower(e) == F.lower(actual), F.lit(False)))


def grade_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Each result (qid = case id) with grade, matched_on and matched_rule_type."""
    rows = results.join(cases.select(F.col("id").alias("qid"), *_LISTS), "qid")
    path, heading = F.lower("source_path"), F.lower(T.joined_path(F.col("heading_path")))
    paths = (path, T.canonical_path(path))
    titles = (heading, F.lower("section_title"), F.lower("document_title"))
    rows = rows.withColumns({
        "bad": matching(F.col("disallowed_document_paths"), *paths), "ps": same(F.col("preferred_source_names"), F.col("source_name")), "as": same(F.col("acceptable_source_names"), F.col("source_name")),
        "pp": matching(F.col("preferred_document_paths"), *paths), "ap": matching(F.col("acceptable_document_paths"), *paths), "ph": matching(F.col("preferred_heading_substrings"), *titles), "ah": matching(F.col("acceptable_heading_substrings"), *titles),
    })
    some = lambda c: F.size(c) > 0
    passes = lambda s, p, h, asked: (some(s) | some(p) | some(h)) & ~(some(asked) & ~some(s))
    strong, weak = passes("ps", "pp", "ph", "preferred_source_names"), passes("as", "ap", "ah", "acceptable_source_names")
    rows = rows.withColumn("grade", F.when(some("bad"), MISS).when(strong, STRONG).when(weak, WEAK).otherwise(MISS))
    tag = lambda word, c: F.transform(c, lambda x: F.concat(F.lit(word + ":"), x))

    def on(word: str, s: str, p: str, h: str) -> tuple[Column, Column]:
        n = some(s).cast("int") + some(p).cast("int") + some(h).cast("int")
        kind = F.when(n >= 2, f"{word}_source+target").when(some(s), f"{word}_source").when(some(p), f"{word}_path").otherwise(f"{word}_heading")
        return F.concat(tag(f"{word}_source", s), tag(f"{word}_path", p), tag(f"{word}_heading", h)), kind

    (p_on, p_kind), (a_on, a_kind) = on("preferred", "ps", "pp", "ph"), on("acceptable", "as", "ap", "ah")
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("matched_on", F.when(some("bad"), tag("disallowed_path", "bad")).when(F.col("grade") == STRONG, p_on).when(F.col("grade") == WEAK, a_on).otherwise(empty))
    rows = rows.withColumn("matched_rule_type", F.when(F.col("grade") == STRONG, p_kind).when(F.col("grade") == WEAK, a_kind))
    return rows.drop("bad", "ps", "as", "pp", "ap", "ph", "ah", *_LISTS)


def grade_bundles(cases: DataFrame, graded: DataFrame, bundles: DataFrame, budget: int = 450) -> DataFrame:
    """The first bundle of each case, graded: case_id, bundle_grade and what it rests on.  ``graded``: case_id, grade."""
    c = cases.select(F.col("id").alias("case_id"), *_LISTS, "allow_mixed_bundle_sources", "max_reasonable_bundle_tokens").join(graded.select("case_id", "grade"), "case_id")
    b = bundles.where("rank = 1").withColumn("b", F.struct(*bundles.columns)).select(F.col("qid").alias("case_id"), "b")
    rows = c.join(b, "case_id", "left")
    part = lambda f: F.transform("b.chunks", f)
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    joined = lambda x: low(T.joined_path(x))
    or_else = lambda *cs: reduce(lambda a, b: F.when(F.size(a) > 0, a).otherwise(b), map(F.col, cs))
    hay = F.concat(F.array(low(F.col("b.source_path")), low(F.col("b.document_title")), low(F.col("b.section_title")), joined(F.col("b.heading_path"))), F.flatten(part(lambda x: F.array(low(x["source_path"]), low(x["section_title"]), joined(x["heading_path"]), low(x["content"])))))
    within = lambda needles: F.filter(needles, lambda n: F.exists("hay", lambda h: F.contains(h, F.lower(n))))
    rows = rows.withColumns({
        "budget": F.coalesce("max_reasonable_bundle_tokens", F.lit(budget)), "paths": or_else("preferred_bundle_paths", "preferred_document_paths", "acceptable_document_paths"),
        "want": or_else("preferred_bundle_source_names", "preferred_source_names"), "accept": or_else("acceptable_bundle_source_names", "acceptable_source_names"),
        "headings": F.array_distinct(F.concat(or_else("preferred_heading_substrings_for_bundle", "preferred_heading_substrings"), F.col("required_heading_substrings_for_bundle"))),
        "hay": hay, "names": F.array_distinct(F.filter(F.concat(F.array("b.source_name"), part(lambda x: x["source_name"])), lambda x: F.coalesce(x, F.lit("")) != "")),
        "all_paths": F.concat(F.array(low(F.col("b.source_path"))), part(lambda x: low(x["source_path"]))), "n": F.col("b.bundle_token_count"), "texts": part(lambda x: F.trim(F.regexp_replace(F.lower(x["content"]), r"\s+", " "))),
    })
    rows = rows.withColumns({
        "matched_paths": F.filter("paths", lambda p: F.exists("all_paths", lambda h: F.contains(h, F.lower(p)) | F.contains(T.canonical_path(h), F.lower(p)))), "m_want": F.filter("names", lambda x: F.array_contains("want", x)), "m_accept": F.filter("names", lambda x: F.array_contains("accept", x)),
        "present": within("required_heading_substrings_for_bundle"), "seen": within("headings"), "coherent": F.size("names") <= 1, "redundant": F.size("texts") - F.size(F.array_distinct("texts")), "in_budget": (F.col("budget") <= 0) | (F.col("n") <= F.col("budget")),
        "far_over": (F.col("budget") > 0) & (F.col("n") > F.floor(F.col("budget") * 1.35)), "thin": (F.col("n") < 40) & (F.size("b.chunks") <= 1), "cut": F.col("b.selection_strategy") == "truncated_match",
    }).withColumn("missing", F.array_except("required_heading_substrings_for_bundle", "present"))
    none = lambda c: F.size(c) == 0
    bad = F.col("b").isNull() | (F.col("grade") == MISS) | ~none("missing") | F.col("far_over") | (~none("want") & none("m_want") & none("m_accept"))
    partial = (~none("paths") & none("matched_paths")) | (~F.col("allow_mixed_bundle_sources") & ~F.col("coherent")) | (~none("want") & none("m_want")) | F.col("thin") | F.col("cut") | (F.col("redundant") > 0) | ~F.col("in_budget") | (~none("headings") & none("seen"))
    comma = lambda c: F.array_join(c, ", ")
    primary = F.coalesce("b.source_name", F.get("names", F.lit(0)))
    tell = lambda test, key, **values: F.when(test, say(BUNDLES[key], **values))
    said = F.filter(
        F.array(
            tell(~none("matched_paths"), "path").when(~none("paths"), BUNDLES["no_path"]), say(BUNDLES["primary"], source=primary),
            tell(~none("want") & ~none("m_want"), "preferred", sources=comma("m_want")).when(~none("want"), BUNDLES["not_preferred"]).when(~none("accept") & ~none("m_accept"), say(BUNDLES["acceptable"], sources=comma("m_accept"))),
            tell(~F.col("allow_mixed_bundle_sources") & ~F.col("coherent"), "mixed", sources=comma("names")), tell(~none("present"), "present", headings=comma("present")), tell(~none("missing"), "missing", headings=comma("missing")),
            tell(~F.col("in_budget"), "over", n=F.col("n"), budget=F.col("budget")), tell(F.col("redundant") > 0, "redundant", n=F.col("redundant")), tell(F.col("thin"), "small"), tell(F.col("cut"), "cut"),
        ),
        lambda x: x.isNotNull(),
    )
    diagnostic = F.when(F.col("b").isNull(), BUNDLES["absent"]).when(F.size(said) == 0, BUNDLES["fine"]).otherwise(F.array_join(said, "; "))
    return rows.select(
        "case_id", F.when(bad, "INSUFFICIENT").when(partial, "PARTIAL").otherwise("COMPLETE").alias("bundle_grade"), F.col("b.source_path").alias("bundle_path"), primary.alias("bundle_source_name"), F.coalesce("names", F.array().cast("array<string>")).alias("bundle_source_names"),
        F.when(F.col("b").isNotNull(), F.col("coherent")).alias("bundle_source_coherent"), F.col("n").alias("bundle_token_count"), F.when(F.col("b").isNotNull(), F.size("b.chunks")).alias("bundle_chunk_count"), F.col("b.selection_strategy").alias("bundle_selection_strategy"),
        F.when(F.col("b").isNotNull(), F.col("in_budget")).alias("bundle_within_budget"), F.when(F.col("b").isNotNull(), ~none("matched_paths")).alias("bundle_matched_path"), F.col("present").alias("bundle_required_headings_present"), F.col("missing").alias("bundle_required_headings_missing"), diagnostic.alias("bundle_diagnostic"),
    )


def outcomes(cases: DataFrame, results: DataFrame, bundles: DataFrame | None = None, budget: int = 450) -> DataFrame:
    """One row per case: grade, ranks, window flags, matched result, failure summary, ranking diagnostic, and the bundle's grade if bundles are given."""
    graded = grade_results(cases, results)
    hit = F.struct("rank", "grade", "source_path", T.joined_path(F.col("heading_path")).alias("heading"), "source_name", "source_type", "matched_rule_type", "matched_on", "chunk_id")
    by = graded.groupBy("qid").agg(
        F.min(F.when(F.col("grade") != MISS, hit)).alias("hit"), F.min(F.when(F.col("grade") == STRONG, hit)).alias("strong"), F.count("*").alias("n"),
        F.min(F.struct("rank", "source_path", "content", "source_name")).alias("top"), F.collect_list(F.struct("rank", "source_name")).alias("sources"),
    )
    rows = cases.join(by, cases["id"] == by["qid"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # the best is the first that passes at all; a strong one behind a weak one doesn't replace it
    rows = rows.withColumn("strong", F.when(F.col("hit.grade") == STRONG, F.col("hit")))
    grade = F.coalesce("hit.grade", F.lit(MISS))
    preferred_rank = F.array_min(F.transform(F.filter("sources", lambda s: F.array_contains("preferred_source_names", s["source_name"])), lambda s: s["rank"]))
    rows = rows.withColumn("grade", grade).withColumn("preferred_source_rank", preferred_rank)
    want = F.size("preferred_source_names") > 0
    wrong = want & F.col("top.source_name").isNotNull() & ~F.array_contains("preferred_source_names", F.col("top.source_name"))
    path = F.col("top.source_path")
    text = F.col("top.content")
    wrapped = F.contains(text, F.lit("import ")) | (F.contains(text, F.lit("<")) & F.contains(text, F.lit("/>")))
    failed = (
        F.when(F.col("n") == 0, FAILURES["nothing"]).when(wrong, say(FAILURES["source"], source=F.col("top.source_name"))).when(path.startswith("versioned_docs/"), say(FAILURES["versioned"], path=path))
        .when(wrapped, say(FAILURES["wrapper"], path=path)).when(F.exists("disallowed_document_paths", lambda p: F.contains(F.lower(path), F.lower(p))), say(FAILURES["disallowed"], path=path))
        .when(F.size("preferred_document_paths") + F.size("acceptable_document_paths") > 0, say(FAILURES["paths"], n=F.col("n"))).otherwise(FAILURES["weak"])
    )
    first = F.get("preferred_source_names", F.lit(0))
    astray = want & (F.col("n") > 0) & ~F.coalesce(F.array_contains("preferred_source_names", F.col("top.source_name")), F.lit(False))
    rank = F.col("hit.rank")
    top = F.coalesce("top.source_name", F.lit("None"))
    ranking = (
        F.when(astray & preferred_rank.isNotNull(), say(RANKINGS["source_later"], source=first, rank=preferred_rank, top=top)).when(astray, say(RANKINGS["source_absent"], top=top, source=first))
        .when(F.col("strong").isNotNull() & (F.col("strong.rank") > 1), say(RANKINGS["preferred_later"], rank=F.col("strong.rank"))).when((grade == MISS) & (F.col("n") > 0), RANKINGS["no_match"])
        .when(grade == MISS, RANKINGS["no_candidates"]).when(rank > 1, say(RANKINGS["later"], rank=rank))
    )
    flags = [F.coalesce((grade == g) & (rank <= k), F.lit(False)).alias(f"{name}_pass_top_{k}") for g, name in ((STRONG, "strong"), (WEAK, "weak")) for k in (1, 3, 5)]
    out = rows.select(
        F.col("id").alias("case_id"), "query", "bucket", "query_style", "concept_id", F.coalesce(first, F.get("acceptable_source_names", F.lit(0))).alias("expected_source_name"), "acceptable_source_names", "top_k", "grade", *flags,
        rank.alias("matched_result_rank"), F.col("hit.source_path").alias("matched_result_path"), F.col("hit.heading").alias("matched_result_heading"), F.col("hit.source_name").alias("matched_result_source_name"), F.col("hit.source_type").alias("matched_result_source_type"),
        F.col("hit.matched_rule_type").alias("matched_rule_type"), F.col("hit.matched_on").alias("matched_on"), F.when(grade == MISS, failed).alias("failure_summary"), F.col("strong.rank").alias("preferred_result_rank"), F.col("strong.source_path").alias("preferred_result_path"),
        "preferred_source_rank", ranking.alias("ranking_diagnostic"),
    )
    if bundles is None:
        return out.withColumns({"bundle_grade": F.lit(None).cast("string"), "bundle_source_names": F.array().cast("array<string>"), "bundle_source_coherent": F.lit(None).cast("boolean")})
    return out.join(grade_bundles(cases, out, bundles, budget), "case_id", "left")


def report(outcomes: DataFrame) -> DataFrame:
    """Long form: one row per dimension (overall, bucket, expected_source, query_style, concept) and label with counts, window rates, bundle grades and case ids.

    Cases without a bucket are ``uncategorized``; without one of the other labels they are
    in no group of that dimension, save for bundle grades by source.
    """
    none = F.lit("uncategorized")
    dim = lambda name, label: F.struct(F.lit(name).alias("dimension"), label.alias("label"))
    dims = F.array(
        dim("overall", F.lit("all")), dim("bucket", F.coalesce("bucket", none)), dim("expected_source", F.col("expected_source_name")),
        dim("query_style", F.col("query_style")), dim("concept", F.col("concept_id")),
    )
    rows = outcomes.withColumn("d", F.explode(dims)).where("d.label is not null")
    at = lambda g, k: F.count_if(F.coalesce((F.col("grade") == g) & (F.col("matched_result_rank") <= k), F.lit(False)))
    n = F.count("*")
    cols = [n.alias("total_queries"), F.count_if(F.col("grade") == STRONG).alias("strong_passes"), F.count_if(F.col("grade") == WEAK).alias("weak_passes"), F.count_if(F.col("grade") == MISS).alias("misses")]
    for k in (1, 3, 5):
        cols += [at(STRONG, k).alias(f"top_{k}_strong_passes"), at(WEAK, k).alias(f"top_{k}_weak_passes"), (n - at(STRONG, k) - at(WEAK, k)).alias(f"top_{k}_misses"), (at(STRONG, k) / n).alias(f"top_{k}_strong_pass_rate"), (at(WEAK, k) / n).alias(f"top_{k}_weak_pass_rate")]
    rated = F.count("bundle_grade")
    for g in ("COMPLETE", "PARTIAL", "INSUFFICIENT"):
        cols += [F.count_if(F.col("bundle_grade") == g).alias(g.lower()), F.when(rated > 0, F.count_if(F.col("bundle_grade") == g) / rated).alias(f"{g.lower()}_rate")]
    cols += [rated.alias("bundles_evaluated"), F.sort_array(F.collect_list("case_id")).alias("case_ids")]
    return rows.groupBy(F.col("d.dimension").alias("dimension"), F.col("d.label").alias("label")).agg(*cols)


def bundle_report(outcomes: DataFrame) -> DataFrame:
    """Bundle grades by bucket and by expected source; cases without either are ``uncategorized``, ungraded ones are left out."""
    dims = F.array(F.struct(F.lit("bucket").alias("dimension"), F.coalesce("bucket", F.lit("uncategorized")).alias("label")), F.struct(F.lit("expected_source").alias("dimension"), F.coalesce("expected_source_name", F.lit("uncategorized")).alias("label")))
    rows = outcomes.where("bundle_grade is not null").withColumn("d", F.explode(dims))
    n = F.count("*")
    count = lambda g: F.count_if(F.col("bundle_grade") == g)
    return rows.groupBy(F.col("d.dimension").alias("dimension"), F.col("d.label").alias("label")).agg(n.alias("total_evaluated"), *(count(g).alias(g.lower()) for g in ("COMPLETE", "PARTIAL", "INSUFFICIENT")), *((count(g) / n).alias(f"{g.lower()}_rate") for g in ("COMPLETE", "PARTIAL", "INSUFFICIENT")))


def source_confusions(outcomes: DataFrame) -> DataFrame:
    """Cases whose result or bundle came from a source that is neither expected nor acceptable, or whose bundle mixes sources."""
    allowed = F.concat(F.array("expected_source_name"), "acceptable_source_names")
    astray = ~F.coalesce(F.array_contains(allowed, F.col("matched_result_source_name")), F.lit(False))
    mixed = (F.size("bundle_source_names") > 0) & (~F.coalesce("bundle_source_coherent", F.lit(True)) | F.exists("bundle_source_names", lambda s: ~F.array_contains(allowed, s)))
    rows = outcomes.where(F.col("expected_source_name").isNotNull() & (astray | F.coalesce(mixed, F.lit(False))))
    return rows.select("case_id", "query", "expected_source_name", "acceptable_source_names", "matched_result_source_name", "matched_result_path", "bundle_source_names", "grade", "bundle_grade")


def _status(better: Column, worse: Column) -> Column:
    return F.when(better & worse, "mixed").when(worse, "regressed").when(better, "improved").otherwise("unchanged")


RETRIEVAL = ("strong_passes", "weak_passes", "misses", "top_1_strong_pass_rate", "top_3_strong_pass_rate", "top_5_strong_pass_rate")
GROUP_RETRIEVAL = ("strong_passes", "weak_passes", "misses", "top_1_strong_pass_rate")
BUNDLE = ("complete", "partial", "insufficient", "complete_rate")


def metric_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(dimension, label, metric_family, metric, current, baseline, delta, better, worse) for labels that both reports have; see ``comparison`` for the others."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = [F.struct(F.lit(f).alias("metric_family"), F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for f, ms in (("retrieval", RETRIEVAL), ("bundle", BUNDLE)) for m in ms]
        rows = df.select("dimension", "label", "bundles_evaluated", F.explode(F.array(*pairs)).alias("p")).select("dimension", "label", "bundles_evaluated", "p.*")
        shown = (F.col("metric_family") == "retrieval") & ((F.col("dimension") == "overall") | F.col("metric").isin(*GROUP_RETRIEVAL)) | (F.col("metric_family") == "bundle") & (F.col("bundles_evaluated") > 0)
        return rows.where(shown).drop("bundles_evaluated")

    rows = long(current, "current").join(long(baseline, "baseline"), ["dimension", "label", "metric_family", "metric"])
    up, down = F.col("current") > F.col("baseline"), F.col("current") < F.col("baseline")
    higher = F.col("metric").isin(*HIGHER)
    return rows.withColumns({"delta": F.col("current") - F.col("baseline"), "better": F.when(higher, up).otherwise(down), "worse": F.when(higher, down).otherwise(up)})


def comparison(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(dimension, label, metric_family, status) of two reports; the overall row of family ``all`` is the verdict.

    A label that only one report has is ``added`` or ``removed``, in the families that it has there.
    """
    d = metric_deltas(current, baseline)
    by = d.groupBy("dimension", "label", "metric_family").agg(_status(F.bool_or("better"), F.bool_or("worse")).alias("status"))
    has = lambda s: F.bool_or(F.col("status") == s)
    all_ = by.where("dimension = 'overall'").groupBy("dimension", "label").agg(F.when(has("mixed") | (has("improved") & has("regressed")), "mixed").when(has("regressed"), "regressed").when(has("improved"), "improved").otherwise("unchanged").alias("status"))
    families = F.explode(F.when(F.col("bundles_evaluated") > 0, F.array(F.lit("retrieval"), F.lit("bundle"))).otherwise(F.array(F.lit("retrieval")))).alias("metric_family")
    alone = lambda one, other, status: one.select("dimension", "label", families).join(other.select("dimension", "label"), ["dimension", "label"], "left_anti").withColumn("status", F.lit(status))
    every = by.unionByName(alone(current, baseline, "added")).unionByName(alone(baseline, current, "removed"))
    return every.unionByName(all_.withColumn("metric_family", F.lit("all")).select("dimension", "label", "metric_family", "status"))


def case_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases of both runs whose retrieval or bundle grade is another."""
    b = baseline.select("case_id", F.col("grade").alias("retrieval_from"), F.col("bundle_grade").alias("bundle_from"))
    rows = current.select("case_id", "query", F.col("grade").alias("retrieval_to"), F.col("bundle_grade").alias("bundle_to")).join(b, "case_id")
    return rows.where(~F.col("retrieval_from").eqNullSafe(F.col("retrieval_to")) | ~F.col("bundle_from").eqNullSafe(F.col("bundle_to"))).select("case_id", "query", "retrieval_from", "retrieval_to", "bundle_from", "bundle_to")


def inconsistent(report_: DataFrame, outcomes_: DataFrame) -> DataFrame:
    """Rows of a report that its outcomes don't give, and the other way round; none if they agree."""
    again = report(outcomes_).select(*report_.columns)
    return report_.exceptAll(again).withColumn("side", F.lit("stored")).unionByName(again.exceptAll(report_).withColumn("side", F.lit("recomputed")))


def validation_status(report_: DataFrame, comparison_: DataFrame | None = None) -> DataFrame:
    """One row: GREEN, GREEN_WITH_WARNINGS or NON_GREEN, and the baseline's status (not_compared without one).

    Misses, insufficient bundles or a regression are not green; weak passes, partial bundles or a mixed comparison are warnings.
    """
    total = report_.where("dimension = 'overall'").select("misses", "weak_passes", "partial", "insufficient")
    base = comparison_.where("metric_family = 'all'").select(F.col("status").alias("baseline_status")) if comparison_ is not None else None
    rows = total.crossJoin(F.broadcast(base)) if base is not None else total.withColumn("baseline_status", F.lit("not_compared"))
    red = (F.col("misses") > 0) | (F.col("insufficient") > 0) | (F.col("baseline_status") == "regressed")
    warned = (F.col("weak_passes") > 0) | (F.col("partial") > 0) | (F.col("baseline_status") == "mixed")
    return rows.select(F.when(red, "NON_GREEN").when(warned, "GREEN_WITH_WARNINGS").otherwise("GREEN").alias("status"), "baseline_status", "misses", "weak_passes", "partial", "insufficient")
