"""Explainable rerank of candidates, deduplication and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import default_rules as D
from . import rules as R

BREAKDOWN = (
    "lexical_score", "title_overlap", "section_overlap", "heading_overlap", "path_overlap", "title_phrase_hits", "section_phrase_hits", "heading_phrase_hits", "path_phrase_hits", "context_hits",
    "exact_heading_phrase", "exact_title_phrase", "intent", "families", "canonical_bonus", "subsystem_bonus", "concept_page_bonus", "plugin_type_penalty", "family_bonus", "section_focus_bonus",
    "incidental_penalty", "example_penalty", "quality_adjustment", "generic_penalty", "anchor_bonus", "expanded", "weighted_score",
)
ADDED = ("canonical_bonus", "subsystem_bonus", "concept_page_bonus", "plugin_type_penalty", "family_bonus", "section_focus_bonus", "incidental_penalty", "example_penalty", "quality_adjustment", "generic_penalty", "anchor_bonus")


def chunk_columns(chunks: DataFrame) -> DataFrame:
    """Chunks with the columns of their metadata that results show."""
    m = F.col("metadata")
    return chunks.select(
        F.col("id").alias("chunk_id"), "section_id", "chunk_order", "content", "token_count", m["document_id"].alias("document_id"), m["document_title"].alias("document_title"), m["source_path"].alias("source_path"),
        T.source_name(m["source_path"], m["source_name"], m["source_type"]).alias("source_name"), T.source_type(m["source_path"], m["source_name"], m["source_type"]).alias("source_type"),
        m["source_url"].alias("source_url"), m["canonical_url"].alias("canonical_url"), m["repo_commit_hash"].alias("repo_commit_hash"), m["section_title"].alias("section_title"), m["heading_path"].alias("heading_path"),
    )


def with_chunks(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates (qid, chunk_id, pass, score) with their chunk's columns and metadata."""
    return candidates.join(chunk_columns(chunks), "chunk_id")


def anchor_bonus(rules=D) -> Column:
    """What the files and folders named in a query are worth, for tasks that look for files."""
    a = rules.ANCHORS
    found = T.anchors(F.col("content"))
    named = F.lower(F.array_join(found, " "))
    around = F.concat_ws(" ", F.lower(T.joined_path(F.col("heading_path"))), F.lower("section_title"), F.lower("document_title"), F.lower("content"))
    base = lambda h: F.element_at(F.split(h, "/"), -1)
    worth = lambda h: F.when(F.contains(named, h), a["file"]).when((base(h) != "") & F.contains(around, base(h)), a["basename"]).otherwise(0.0)
    files = F.aggregate(F.transform("file_hints", lambda h: worth(F.lower(h))), F.lit(0.0), lambda x, y: x + y)
    trees = F.aggregate(F.transform("subtree_hints", lambda h: F.when(F.contains(around, h) | F.contains(named, h), a["subtree"]).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y)
    generic = F.exists(found, lambda x: ~F.contains(x, F.lit("/")) & F.lower(x).rlike(rules.GENERIC_ANCHOR))
    missed_file = F.when((F.size("file_hints") > 0) & (F.size(found) > 0) & (files == 0), F.lit(a["missed_file"]) + F.when(generic, a["generic"]).otherwise(0.0)).otherwise(0.0)
    missed_tree = F.when((F.size("subtree_hints") > 0) & (F.size(found) > 0) & (trees == 0), a["missed_subtree"]).otherwise(0.0)
    return F.when(F.col("task").isin("implementation_guide", "file_location"), files + missed_file + trees + missed_tree).otherwise(0.0)


def signals(rows: DataFrame, rules=D) -> DataFrame:
    """Candidates joined with their profile: every signal as a column, then weighted_score."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    heading = T.joined_path(F.coalesce("heading_path", F.array().cast("array<string>")))
    rows = rows.withColumns({"title_text": low(F.col("document_title")), "section_text": low(F.col("section_title")), "heading_text": low(heading), "path_text": low(F.col("source_path"))})
    rows = rows.withColumn("lexical_score", F.greatest(F.lit(0.0), -F.col("score")))
    rows = rows.withColumns({f"{f}_overlap": T.overlap(F.col(f"{f}_text"), F.col("expanded")) for f in ("title", "section", "heading", "path")} | {f"{f}_phrase_hits": T.overlap(F.col(f"{f}_text"), F.col("phrases")) for f in ("title", "section", "heading", "path")})
    inside = lambda c: (F.col("normalized") != "") & F.contains(T.normalized(c, rules.STOPWORDS), F.col("normalized"))
    anywhere = F.filter("expanded", lambda t: reduce(lambda a, b: a | b, (F.contains(F.col(f"{f}_text"), t) for f in ("path", "title", "section", "heading"))))
    rows = rows.withColumns({
        "context_hits": F.size(anywhere), "exact_heading_phrase": inside(F.array_join("heading_path", " ")).cast("int"), "exact_title_phrase": inside(F.col("document_title")).cast("int"),
        "focus": F.col("section_overlap") + F.col("heading_overlap"), "phrase_focus": F.col("section_phrase_hits") + F.col("heading_phrase_hits"), "flow_focus": F.col("heading_overlap") + F.col("section_phrase_hits") + F.col("heading_phrase_hits"),
        "n_families": F.size("families"), "path_depth": F.length("path_text") - F.length(F.replace("path_text", F.lit("/"))),
    }).withColumn("focus_lead", F.col("focus") - F.col("title_overlap"))
    rows = rows.withColumns({
        "canonical_bonus": F.when(T.is_canonical(F.col("source_path")), rules.CANONICAL[0]).otherwise(rules.CANONICAL[1]), "subsystem_bonus": R.total(rules.SUBSYSTEM), "concept_page_bonus": R.total(rules.CONCEPT_PAGE),
        "plugin_type_penalty": R.total(rules.PLUGIN_TYPE), "family_bonus": R.total(rules.FAMILY_BONUS), "section_focus_bonus": R.total(rules.SECTION_FOCUS), "incidental_penalty": R.total(rules.INCIDENTAL),
        "example_penalty": R.total(rules.EXAMPLE), "quality_adjustment": R.total(rules.QUALITY), "generic_penalty": R.total(rules.GENERIC), "anchor_bonus": anchor_bonus(rules),
    })
    terms = [F.col("lexical_score"), *(F.col(c) * float(w) for c, w in rules.WEIGHTS.items()), *map(F.col, ADDED)]
    return rows.withColumn("weighted_score", reduce(lambda a, b: a + b, terms))


def rerank(candidates: DataFrame, profiles: DataFrame, chunks: DataFrame, top_k: int = 5, rules=D) -> DataFrame:
    """Ranked results of each query (qid, rank, ...) with the breakdown of their scores.

    Order: score, canonical paths first, lexical score, fewer tokens, id.  Of results with one canonical path, heading path and section
    title the best stays.
    """
    rows = signals(with_chunks(candidates, chunks).join(profiles, "qid"), rules)
    order = [F.desc("weighted_score"), T.is_canonical(F.col("source_path")).desc(), F.col("score"), F.col("token_count"), F.col("chunk_id")]
    same = [F.col("qid"), T.canonical_path(F.col("source_path")), F.array_join("heading_path", "\u0001"), F.col("section_text")]
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).where("copy = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= top_k)
    shown = F.struct(*(F.round(c, 3).alias(c) if c in ("lexical_score", "weighted_score") else F.col(c) for c in BREAKDOWN))
    return rows.select(
        "qid", "rank", "chunk_id", "document_id", "section_id", "chunk_order", "score", F.col("weighted_score").alias("rerank_score"), "source_path", "source_name", "source_type", "source_url", "canonical_url",
        "document_title", "section_title", "heading_path", "repo_commit_hash", "content", "token_count", F.col("normalized").alias("normalized_query"), shown.alias("breakdown"),
    )
