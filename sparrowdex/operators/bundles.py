"""Token-budgeted context bundles around ranked results, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import default_rules as D
from . import rules as R
from .rerank import chunk_columns

_PART = "struct<chunk_id:string,role:string,content:string,token_count:int,source_path:string,source_name:string,source_type:string,source_url:string,canonical_url:string,section_title:string,heading_path:array<string>>"
LEAST_MATCH = 80


def compact(content: Column) -> Column:
    """Without the heading line at the top, if anything is left then."""
    c = T.strip(F.regexp_replace(content, r"(?s)^Heading:\s.*?(?:\n\n|\n)", ""))
    return F.when(c != "", c).otherwise(T.strip(content))


def _part(role: Column, content: Column, tokens: Column, row: Column | None = None) -> Column:
    of = (lambda c: F.col(c)) if row is None else (lambda c: row[c])
    return F.struct(of("chunk_id").alias("chunk_id"), role.alias("role"), content.alias("content"), tokens.cast("int").alias("token_count"), *(of(c).alias(c) for c in ("source_path", "source_name", "source_type", "source_url", "canonical_url", "section_title", "heading_path"))).cast(_PART)


def _neighbours(results: DataFrame, all_chunks: DataFrame, previous: bool, following: bool, budget: int) -> DataFrame:
    """Adds ``before`` and ``after``: parts of the section on either side that fit, nearest first, taken in turn until a turn adds none."""
    empty = F.array().cast(f"array<{_PART}>")
    if not (previous or following):
        return results.withColumns({"before": empty, "after": empty})
    here = all_chunks.select("section_id", F.struct(*(c for c in all_chunks.columns if c != "section_id")).alias("o"))
    pairs = results.select("qid", "rank", "section_id", F.col("chunk_order").alias("at")).join(here, "section_id").where(F.col("o.chunk_order") != F.col("at"))
    away = F.abs(F.col("o.chunk_order") - F.col("at"))
    pairs = pairs.where((F.col("o.chunk_order") < F.col("at")) if not following else (F.col("o.chunk_order") > F.col("at")) if not previous else F.lit(True))
    small = compact(F.col("o.content"))
    side = (F.col("o.chunk_order") > F.col("at")).cast("int")
    part = _part(F.when(side == 0, "previous").otherwise("next"), small, T.count_tokens(small), F.col("o"))
    near = pairs.groupBy("qid", "rank").agg(F.sort_array(F.collect_list(F.struct(away.alias("away"), side.alias("side"), part.alias("part")))).alias("near"))
    rows = results.join(near, ["qid", "rank"], "left")
    start = F.struct(F.col("match_tokens").alias("total"), F.lit(0).alias("away"), F.lit(True).alias("added"), F.lit(False).alias("stopped"), empty.alias("before"), empty.alias("after"))

    def step(s: Column, x: Column) -> Column:
        turn = x["away"] != s["away"]
        stopped = s["stopped"] | (turn & ~s["added"])
        fits = ~stopped & (s["total"] + x["part"]["token_count"] <= budget)
        added = F.when(turn, fits).otherwise(s["added"] | fits)
        return F.struct(
            (s["total"] + F.when(fits, x["part"]["token_count"]).otherwise(0)).cast("int").alias("total"), x["away"].cast("int").alias("away"), added.alias("added"), stopped.alias("stopped"),
            F.when(fits & (x["side"] == 0), F.concat(s["before"], F.array(x["part"]))).otherwise(s["before"]).alias("before"), F.when(fits & (x["side"] == 1), F.concat(s["after"], F.array(x["part"]))).otherwise(s["after"]).alias("after"),
        )

    room = F.col("near").isNotNull() & (F.lit(budget) > F.col("match_tokens"))
    grown = F.when(room, F.aggregate("near", start, step)).otherwise(start)
    return rows.withColumn("grown", grown).withColumns({"before": F.col("grown.before"), "after": F.col("grown.after")}).drop("grown", "near")


def support_candidates(results: DataFrame, all_chunks: DataFrame, pool: int = 5) -> DataFrame:
    """(qid, rank, and a chunk's columns): each query's other results, the chunks of the result's document and of its first ``pool`` results' documents, once each."""
    key = results.select("qid", "rank", F.col("chunk_id").alias("primary_id"), "document_id")
    by_result = key.select("qid", "rank", "primary_id").join(results.select("qid", "chunk_id"), "qid")
    docs = results.where(F.col("rank") <= pool).select("qid", "document_id")
    wanted = key.select("qid", "rank", "primary_id").join(docs, "qid").union(key.select("qid", "rank", "primary_id", "document_id")).distinct()
    by_doc = wanted.join(all_chunks.select("document_id", "chunk_id"), "document_id").select("qid", "rank", "primary_id", "chunk_id")
    ids = by_result.union(by_doc).where("chunk_id <> primary_id").distinct()
    return ids.drop("primary_id").join(all_chunks, "chunk_id")


def support_score(rules=D) -> Column:
    """Worth of a support chunk (c_ columns, with heading_text and the like) for the primary result (p_ columns)."""
    tier = lambda t: F.when(F.length(t) < 3, 0).when(F.contains(F.col("heading_text"), t), 3).when(F.contains(F.col("section_text"), t) | F.contains(F.col("title_text"), t), 2).when(F.contains(F.col("content_text"), t), 1).otherwise(0)
    overlap = F.aggregate(F.transform("expanded", tier), F.lit(0), lambda a, b: a + b)
    same = F.when(F.col("document_id") == F.col("p_document_id"), 4.0).when(T.canonical_path(F.col("source_path")) == T.canonical_path(F.col("p_source_path")), 2.0).otherwise(0.0)
    sibling = F.when((F.col("source_path") == F.col("p_source_path")) & (F.col("section_id") != F.col("p_section_id")), 4.0).otherwise(0.0)
    expected = R.labels(rules.EXPECTED_ANCHORS)
    named = F.aggregate(F.transform(expected, lambda a: F.when(F.contains(F.col("content_text"), a), 16.0).otherwise(0.0) + F.when(F.contains(F.col("heading_text"), a) | F.contains(F.col("section_text"), a), 10.0).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    return T.let(overlap, lambda n: n + F.when(n == 0, -8.0).otherwise(0.0)) + same + sibling + named + R.total(rules.SUPPORT)


def bundles(results: DataFrame, profiles: DataFrame, chunks: DataFrame, include_previous: bool = False, include_next: bool = False, max_tokens: int = 600, rules=D) -> DataFrame:
    """One bundle per result: qid, rank, the result's columns, chunks, bundle_token_count, selection_strategy, diagnostics."""
    every = chunk_columns(chunks)
    p = profiles.select("qid", "task", "families", "expanded")
    cut = (F.col("token_count") > max_tokens) if max_tokens > 0 else F.lit(False)
    rows = results.drop("breakdown").withColumn("match_content", F.when(cut, T.truncate_tokens(F.col("content"), F.lit(max_tokens))).otherwise(F.col("content"))).withColumn("match_tokens", F.when(cut, T.count_tokens(F.col("match_content"))).otherwise(F.col("token_count")))
    rows = _neighbours(rows, every, include_previous, include_next, max_tokens)
    match = F.array(_part(F.lit("match"), F.col("match_content"), F.col("match_tokens")))
    rows = rows.withColumn("parts", F.concat(F.reverse("before"), match, "after"))
    rows = rows.withColumn("strategy", F.when(F.size("parts") > 1, "section_window").when(cut, "truncated_match").otherwise("match_only"))
    tokens = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + x["token_count"])
    rows = rows.withColumn("total", tokens(F.col("parts"))).join(p, "qid")

    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    heading = F.lower(T.joined_path(F.col("heading_path")))
    rows = rows.withColumns({"path_text": low("source_path"), "heading_text": heading, "section_text": low("section_title"), "content_text": low("content")})
    rows = rows.withColumn("all_text", F.concat_ws(" ", "heading_text", "section_text", "content_text"))
    reason = F.when(F.col("total") < max_tokens, F.when(F.col("task") != "general", F.col("task")).otherwise(F.nullif(R.first(rules.SUPPORT_REASON, ""), F.lit(""))))
    rows = rows.withColumn("support_reason", reason)
    expected = R.labels(rules.EXPECTED_ANCHORS)
    answered = F.exists(expected, lambda a: F.contains(F.col("content_text"), a)) & (F.col("task") != "implementation_guide")
    rows = rows.withColumn("answered", answered).drop("heading_text", "section_text", "content_text", "all_text", "path_text")

    asked = rows.where("support_reason is not null and not answered")
    mine = asked.select("qid", "rank", "task", "families", "expanded", F.col("document_id").alias("p_document_id"), F.col("source_path").alias("p_source_path"), F.col("section_id").alias("p_section_id"), F.transform("parts", lambda x: x["chunk_id"]).alias("used"))
    pool = support_candidates(results, every).join(mine, ["qid", "rank"]).where(~F.array_contains("used", F.col("chunk_id")))
    pool = pool.withColumns({"path_text": low("source_path"), "heading_text": heading, "section_text": low("section_title"), "title_text": low("document_title"), "content_text": low("content"), "n_anchors": F.size(T.anchors(F.col("content")))})
    pool = pool.withColumn("support", support_score(rules))
    w = Window.partitionBy("qid", "rank").orderBy(F.col("token_count") > max(max_tokens - 80, 0), F.desc("support"), "token_count", "chunk_id")
    best = pool.withColumn("place", F.row_number().over(w)).where("place = 1 and support > 0")
    small = compact(F.col("content"))
    best = best.select("qid", "rank", _part(F.lit("support"), small, T.count_tokens(small)).alias("extra"), T.anchors(F.col("content")).alias("support_anchors"))
    rows = rows.join(best, ["qid", "rank"], "left")

    has = F.col("extra").isNotNull()
    fits = has & (F.col("total") + F.col("extra.token_count") <= max_tokens)
    room = F.lit(max_tokens) - F.col("extra.token_count")
    head = F.element_at("parts", 1)
    trimmed = T.truncate_tokens(head["content"], room)
    rows = rows.withColumn("trimmed", F.when(has & ~fits & (room >= LEAST_MATCH), trimmed)).withColumn("trimmed_tokens", F.when(F.col("trimmed").isNotNull(), T.count_tokens(F.col("trimmed"))))
    trims = F.coalesce(F.col("trimmed_tokens") >= LEAST_MATCH, F.lit(False))
    short = head.withField("content", F.col("trimmed")).withField("token_count", F.col("trimmed_tokens"))
    parts = F.when(fits, F.concat("parts", F.array("extra"))).when(trims, F.concat(F.array(short), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), F.array("extra"))).otherwise(F.col("parts"))
    rows = rows.withColumn("strategy", F.when(fits, "task_support").when(trims, "task_support_truncated").otherwise(F.col("strategy"))).withColumn("added", fits | trims).withColumn("trims", trims & ~fits).withColumn("has_extra", has).withColumn("parts", parts)
    rows = rows.withColumn("bundle_token_count", tokens(F.col("parts")))
    plain = F.transform("parts", lambda x: F.trim(F.regexp_replace(F.lower(x["content"]), r"\s+", " ")))
    asked_for = F.col("support_reason").isNotNull()
    diagnostics = F.struct(
        F.lit(max_tokens).alias("bundle_max_tokens"), (F.lit(max_tokens <= 0) | (F.col("bundle_token_count") <= max_tokens)).alias("within_budget"), F.size("parts").alias("chunk_count"), F.transform("parts", lambda x: x["role"]).alias("chunk_roles"),
        (F.col("strategy") == "truncated_match").alias("truncated"), (F.size(plain) - F.size(F.array_distinct(plain))).alias("duplicate_chunk_count"), F.col("task").alias("task_intent"), F.col("families").alias("concept_families"),
        F.col("support_reason").alias("support_reason"), F.when(asked_for, F.coalesce("added", F.lit(False))).alias("support_added"), F.when(asked_for & ~F.coalesce("added", F.lit(False)), F.when(F.col("has_extra"), "budget").otherwise("no_candidate")).alias("support_rejected"),
        F.when(F.col("added"), F.col("extra.chunk_id")).alias("support_chunk_id"), F.when(F.col("added"), F.col("extra.source_path")).alias("support_source_path"), F.when(F.col("added"), F.col("support_anchors")).alias("support_file_anchors"), F.when(F.col("added"), F.col("trims")).alias("support_trimmed_match"),
    )
    return rows.select(
        "qid", "rank", "score", "bundle_token_count", "source_path", "source_name", "source_type", "source_url", "canonical_url", "document_title", "section_title", "heading_path", "repo_commit_hash",
        F.col("parts").alias("chunks"), F.col("strategy").alias("selection_strategy"), diagnostics.alias("diagnostics"),
    )
