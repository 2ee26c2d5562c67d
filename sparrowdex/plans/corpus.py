"""Canonical documents and sections of the supplied tables."""

from __future__ import annotations

import inspect
import sys
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parsing
from ..operators.chunking import chunk
from .store import Store, ingest, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each row of ``documents`` as a document of one section without a heading; texts without content have no section."""
    rows = table(spark, sf_dir, "documents").where("doc_id is not null")
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = rows.withColumn("source_path", path).withColumn("document_id", T.stable_id("document", F.col("source_path")))
    none = F.lit(None)
    docs = rows.select(
        F.col("document_id").alias("id"), "source_path", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("repo_markdown").alias("source_type"), F.col("source").alias("source_name"), none.cast("string").alias("source_url"),
        none.cast("string").alias("canonical_url"), none.cast("string").alias("repo_commit_hash"), none.cast("timestamp").alias("last_modified_time"), none.cast("timestamp").alias("scrape_timestamp"), F.sha1(F.coalesce("text", F.lit(""))).alias("file_hash"), F.sha1(F.coalesce("text", F.lit(""))).alias("content_hash"),
    )
    content = T.strip(F.coalesce("text", F.lit("")))
    secs = rows.select("document_id", F.lit(0).alias("section_order"), none.cast("string").alias("section_title"), F.lit(0).alias("heading_level"), F.array().cast("array<string>").alias("heading_path"), content.alias("content"))
    return docs, parsing._sections(secs)


def conversations_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a markdown file: its number as the first heading, each turn below a heading with its role."""
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("## "), t["role"], F.lit("\n\n"), t["text"], F.lit("\n"))), "\n")
    raw = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), body)
    return turns.select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("source_path"), raw.alias("raw"), F.lit(None).cast("timestamp").alias("modified"))


def conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parsing.markdown(conversations_markdown(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return parsing.html(table(spark, sf_dir, "pages").where("html is not null and url is not null").select("url", "html", F.lit(None).cast("timestamp").alias("scraped")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(*documents(spark, sf_dir))


def _code() -> str:
    """A hash of the code that makes a store, so that one made by other code is not read."""
    from ..operators import chunking, index
    from . import store as module

    return sha1("".join(inspect.getsource(m) for m in (T, chunking, index, module, sys.modules[__name__])).encode()).hexdigest()


def store(spark: SparkSession, sf_dir: str, anew: bool = False) -> Store:
    """The store of ``documents``: ingested into the shared folder when it is first asked for or ``anew``, and again when the table's files or the code change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listStatus(path) if fs.getFileStatus(path).isDirectory() else [fs.getFileStatus(path)]
    state = "|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files))
    out = Store(spark, f"{shared_dir(spark)}/sparrowdex/corpus-{sha1(f'{_code()}|{state}'.encode()).hexdigest()}")
    if anew or out.version() is None:
        ingest(out, *documents(spark, sf_dir))
    return out


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a query."""
    return table(spark, sf_dir, "benchmark").where("item_id is not null").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("raw_query"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as an eval case whose preferred and acceptable sources follow its number."""
    rows = table(spark, sf_dir, "benchmark").where("item_id is not null")
    n = F.col("item_id")
    src = lambda k: F.concat(F.lit("src"), ((n + k) % 20).cast("string"))
    return rows.select(
        F.concat(F.lit("b"), n.cast("string")).alias("id"), F.col("text").alias("query"), F.when(n % 5 > 0, F.concat(F.lit("bucket"), (n % 5).cast("string"))).alias("bucket"), F.when(n % 2 == 0, "even").alias("query_style"), F.concat(F.lit("c"), (n % 3).cast("string")).alias("concept_id"),
        F.when(n % 3 == 0, F.array(src(0), F.lit("src0"))).alias("preferred_source_names"), F.when(n % 3 == 1, F.array(src(1), src(2), F.lit("src0"))).alias("acceptable_source_names"), F.when(n % 3 == 2, F.array(F.lit("docs/src1"))).alias("preferred_document_paths"),
        F.when(n % 3 == 2, F.array(F.lit("7.md"))).alias("acceptable_document_paths"), F.when(n % 7 == 0, F.array(F.lit("docs/src3/"))).alias("disallowed_document_paths"),
    )
