"""The versioned JSON contract of bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import default_rules as D
from .wording import CONTRACT, say

VERSION = "v1"
_STRINGS = "array<string>"


def generic_anchor(a: Column, rules=D) -> Column:
    plain = F.regexp_replace(a, "^/+|/+$", "")
    return ~F.contains(plain, F.lit("/")) & F.lower(plain).rlike(rules.GENERIC_ANCHOR)


def file_anchors(texts: Column, rules=D) -> Column:
    """Files named in the texts, those that the query (file_hints, subtree_hints) asks for first; no names of examples where a path is named."""
    base = lambda a: F.element_at(F.split(F.lower(a), "/"), -1)
    pathlike = lambda a: F.contains(F.regexp_replace(a, "^/+|/+$", ""), F.lit("/"))

    def rank(a: Column) -> Column:
        files = F.size(F.filter("file_hints", lambda h: (F.lower(h) == F.lower(a)) | (base(h) == base(a))))
        trees = F.size(F.filter("subtree_hints", lambda h: F.contains(F.lower(a), h)))
        return files * 10 + trees * 6 + pathlike(a).cast("int") * 3 + (~generic_anchor(a, rules)).cast("int")

    every = F.array_distinct(F.flatten(F.transform(texts, T.anchors)))
    ranked = F.transform(F.reverse(F.array_sort(F.transform(every, lambda a: F.struct(rank(a).alias("rank"), F.length(a).alias("n"), a.alias("a"))))), lambda x: x["a"])
    return T.let(ranked, lambda r: T.let(F.filter(r, lambda a: ~(F.exists(r, pathlike) & generic_anchor(a, rules))), lambda k: F.when(F.size(k) > 0, k).otherwise(r)))


def without_heading_lines(content: Column) -> Column:
    lines = F.transform(F.split(content, r"\r\n|[\n\r]"), F.trim)
    return F.trim(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("Heading: ")), " "))


def points(text: Column) -> Column:
    """Up to four distinct sentences of 20 characters or more."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[- ]+|[- ]+$", "")))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 20)), 1, 4)


def contract_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("||", *(F.trim(F.coalesce(p, F.lit(""))) for p in parts))), 1, 16)


def confidence(rank: Column) -> Column:
    return F.when(rank == 1, "high").when(rank <= 3, "medium").otherwise("low")


def summary(title: Column, place: Column, leads: Column) -> Column:
    """What a result is about: its title and place, and the first of its points if there are any."""
    return F.when(F.size(leads) > 0, say(CONTRACT["summary"], title=title, place=place, point=F.get(leads, F.lit(0)))).otherwise(say(CONTRACT["title"], title=title, place=place))


def key_points(texts: Column) -> Column:
    """Up to four distinct points of the texts, in their order."""
    return F.slice(F.array_distinct(F.flatten(F.transform(texts, lambda c: points(without_heading_lines(c))))), 1, 4)


def results(bundles: DataFrame, profiles: DataFrame, rules=D) -> DataFrame:
    """(qid, rank, result): the contract's result of each bundle."""
    rows = bundles.join(profiles.select("qid", "file_hints", "subtree_hints"), "qid")
    heading = T.joined_path(F.col("heading_path"))
    where = F.when(F.size("heading_path") > 0, heading).otherwise(F.coalesce(F.nullif("section_title", F.lit("")), F.col("document_title")))
    place = F.when(F.size("heading_path") > 0, heading).otherwise(F.col("document_title"))
    leads = points(without_heading_lines(F.element_at("chunks", 1)["content"]))
    reason = F.col("diagnostics.support_reason")
    explained = F.concat(say(CONTRACT["ranking"], rank=F.col("rank"), source=F.coalesce("source_name", F.lit("unknown-source")), place=where), F.coalesce(say(CONTRACT["support"], reason=reason), F.lit("")))
    section = lambda c: F.struct(
        c["chunk_id"].alias("id"), c["role"].alias("role"), F.col("document_title"), c["source_path"].alias("source_path"), c["source_url"].alias("source_url"), c["canonical_url"].alias("canonical_url"),
        c["section_title"].alias("section_title"), F.coalesce(c["heading_path"], F.array().cast(_STRINGS)).alias("heading_path"), c["token_count"].alias("token_count"), c["content"].alias("content"),
    )
    result = F.struct(
        contract_id(F.col("source_path"), F.col("section_title"), heading).alias("id"), F.lit("knowledge_bundle").alias("type"), F.col("rank"), confidence(F.col("rank")).alias("confidence"),
        F.struct(F.col("source_name").alias("name"), F.col("source_type").alias("type"), F.col("source_url").alias("url"), F.col("canonical_url"), F.col("source_path").alias("path"), F.col("document_title"), F.col("section_title"), F.col("heading_path")).alias("source"),
        F.struct(
            summary(F.col("document_title"), place, leads).alias("summary"), F.transform("chunks", section).alias("sections"), F.coalesce(file_anchors(F.transform("chunks", lambda c: c["content"]), rules), F.array().cast(_STRINGS)).alias("file_anchors"),
            key_points(F.transform("chunks", lambda c: c["content"])).alias("key_points"),
        ).alias("content"),
        F.struct(explained.alias("ranking_explanation"), reason.alias("support_reason"), F.col("bundle_token_count").alias("token_count"), F.col("selection_strategy")).alias("diagnostics"),
    )
    return rows.select("qid", "rank", result.alias("result"))


def envelopes(bundles: DataFrame, profiles: DataFrame, top_k: int = 5, tool: str = "sparrowdex", rules=D) -> DataFrame:
    """(qid, tool, version, query, normalized_query, intent, results): one envelope per query, without results where nothing was found."""
    rows = results(bundles.where(F.col("rank") <= top_k), profiles, rules)
    kind = rows.schema["result"].dataType.simpleString()
    lists = rows.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "result"))), lambda x: x["result"]).alias("results"))
    out = profiles.join(lists, "qid", "left")
    intent = F.struct(F.col("intent").alias("query_intent"), F.col("task").alias("task_intent"), F.col("families").alias("concept_families"))
    return out.select("qid", F.lit(tool).alias("tool"), F.lit(VERSION).alias("version"), F.col("raw_query").alias("query"), F.col("normalized").alias("normalized_query"), intent.alias("intent"), F.coalesce("results", F.array().cast(f"array<{kind}>")).alias("results"))


def as_json(envelopes: DataFrame) -> DataFrame:
    """(qid, json) with nulls and empty arrays present."""
    return envelopes.select("qid", F.to_json(F.struct(*(c for c in envelopes.columns if c != "qid")), {"ignoreNullFields": "false"}).alias("json"))


#: The envelope's schema, and which of its values may not be null.
SCHEMA = (
    "tool string, version string, query string, normalized_query string, intent struct<query_intent:string, task_intent:string, concept_families:array<string>>, "
    "results array<struct<id:string, type:string, rank:int, confidence:string, "
    "source:struct<name:string, type:string, url:string, canonical_url:string, path:string, document_title:string, section_title:string, heading_path:array<string>>, "
    "content:struct<summary:string, sections:array<struct<id:string, role:string, document_title:string, source_path:string, source_url:string, canonical_url:string, section_title:string, heading_path:array<string>, token_count:int, content:string>>, "
    "file_anchors:array<string>, key_points:array<string>>, "
    "diagnostics:struct<ranking_explanation:string, support_reason:string, token_count:int, selection_strategy:string>>>"
)
NEVER_NULL = {
    "": ("tool", "version", "query", "normalized_query", "results"), "intent": ("query_intent", "task_intent", "concept_families"), "result": ("id", "type", "rank", "confidence"), "source": ("path", "document_title", "heading_path"),
    "content": ("summary", "sections", "file_anchors", "key_points"), "section": ("id", "role", "document_title", "source_path", "heading_path", "token_count", "content"), "diagnostics": ("ranking_explanation", "token_count", "selection_strategy"),
}


def schema_violations(json: DataFrame) -> DataFrame:
    """(qid, problem) of envelopes as text (qid, json): keys that are missing, unknown or of another type, and nulls where none may be.

    An envelope has the schema's keys and types and no others if and only if it comes back unchanged when it is read with the schema and written again.
    """
    rows = json.withColumn("e", F.from_json("json", SCHEMA))
    again = F.to_json("e", {"ignoreNullFields": "false"})
    null = lambda at, c: F.array(*(F.when(c[k].isNull(), F.lit(f"{at}{'.' if at else ''}{k} is null")) for k in NEVER_NULL[at]))
    within = lambda at, items, of: F.flatten(F.transform(F.coalesce(items, F.array()), lambda x: null(at, of(x))))
    e = F.col("e")
    found = F.concat(
        F.array(F.when(e.isNull() | (again != F.col("json")), F.lit("keys or types are not those of the schema"))), null("", e), null("intent", e["intent"]), within("result", e["results"], lambda r: r),
        within("source", e["results"], lambda r: r["source"]), within("content", e["results"], lambda r: r["content"]), within("diagnostics", e["results"], lambda r: r["diagnostics"]),
        within("section", F.flatten(F.transform(F.coalesce(e["results"], F.array()), lambda r: F.coalesce(r["content"]["sections"], F.array()))), lambda x: x),
    )
    return rows.select("qid", F.explode(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias("problem"))


def violations(envelopes: DataFrame) -> DataFrame:
    """(qid, problem): what an envelope that follows the contract can't have."""
    r = F.col("r")
    rows = envelopes.select("qid", "query", F.posexplode_outer("results").alias("at", "r"))
    checks = {
        "query is null": F.col("query").isNull(),
        "ranks aren't gapless": r.isNotNull() & (r["rank"] != F.col("at") + 1),
        "id isn't 16 hexadecimal digits": r.isNotNull() & ~r["id"].rlike("^[0-9a-f]{16}$"),
        "confidence is unknown": r.isNotNull() & ~r["confidence"].isin("high", "medium", "low"),
        "summary is empty": r.isNotNull() & (F.coalesce(r["content"]["summary"], F.lit("")) == ""),
        "no sections": r.isNotNull() & (F.coalesce(F.size(r["content"]["sections"]), F.lit(0)) == 0),
        "an array is null": r.isNotNull() & (r["content"]["file_anchors"].isNull() | r["content"]["key_points"].isNull()),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())), lambda x: x.isNotNull())
    return rows.select("qid", F.explode(found).alias("problem")).distinct()
