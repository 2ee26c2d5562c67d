"""Statistics of a store, and lookups of one document or chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def overview(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, sections, chunks, avg_chunk_tokens (0 without chunks)."""
    c = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_chunk_tokens"))
    return documents.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(sections.agg(F.count("*").alias("sections")))).crossJoin(F.broadcast(c))


def _chunks_by_document(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    s = sections.select(F.col("id").alias("section_id"), "document_id")
    per_section = chunks.groupBy("section_id").agg(F.count("*").alias("n"))
    return s.join(per_section, "section_id", "left").groupBy("document_id").agg(F.count("*").alias("section_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"))


def chunks_per_document(documents: DataFrame, sections: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """The documents with most chunks; documents without any count 0."""
    n = _chunks_by_document(sections, chunks)
    rows = documents.join(n, documents["id"] == n["document_id"], "left").select("source_path", "title", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
    return rows.orderBy(F.desc("chunk_count"), "source_path").limit(limit)


def _located(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    s = sections.select(F.col("id").alias("section_id"), "document_id", T.joined_path(F.col("heading_path")).alias("heading_path"))
    d = documents.select(F.col("id").alias("document_id"), "source_path")
    return chunks.select(F.col("id").alias("chunk_id"), "section_id", "token_count", "content").join(s, "section_id").join(d, "document_id")


def largest_chunks(documents: DataFrame, sections: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    top = chunks.orderBy(F.desc("token_count"), "id").limit(limit)
    return _located(documents, sections, top).select("chunk_id", "source_path", "heading_path", "token_count").orderBy(F.desc("token_count"), "chunk_id")


def small_chunks(documents: DataFrame, sections: DataFrame, chunks: DataFrame, most: int = 30, limit: int = 10) -> DataFrame:
    low = chunks.where(F.col("token_count") <= most).orderBy("token_count", "id").limit(limit)
    return _located(documents, sections, low).select("chunk_id", "source_path", "heading_path", "token_count").orderBy("token_count", "chunk_id")


def duplicate_chunks(documents: DataFrame, sections: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Contents that several chunks share; grouped by their hash, so that texts are not shuffled."""
    rows = _located(documents, sections, chunks.withColumn("content", F.sha2("content", 256)))
    found = rows.groupBy("content").agg(F.count("*").alias("duplicate_count"), F.min("chunk_id").alias("sample_chunk_id"), F.min("source_path").alias("sample_source_path")).where("duplicate_count > 1")
    return found.select("duplicate_count", "sample_chunk_id", "sample_source_path").orderBy(F.desc("duplicate_count"), "sample_chunk_id").limit(limit)


def source_counts(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, sections and chunks by source; counts are added up by document first, so nothing fans out."""
    n = _chunks_by_document(sections, chunks)
    rows = documents.join(n, documents["id"] == n["document_id"], "left")
    return rows.groupBy("source_type", F.coalesce("source_name", F.lit("")).alias("source_name")).agg(
        F.count("*").alias("document_count"), F.coalesce(F.sum("section_count"), F.lit(0)).cast("long").alias("section_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunk_count")
    ).orderBy(F.desc("chunk_count"), "source_type", "source_name")


def inspect_chunk(documents: DataFrame, sections: DataFrame, chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk with its section and document; no row if there is none."""
    c = chunks.where(F.col("id") == chunk_id)
    s = sections.select(F.col("id").alias("section_id"), "document_id", "section_title", "heading_level", "heading_path", "section_order")
    d = documents.select(F.col("id").alias("document_id"), "title", "source_path", "source_type", "source_name")
    return c.withColumnRenamed("id", "chunk_id").join(s, "section_id").join(d, "document_id")


def inspect_document(documents: DataFrame, sections: DataFrame, chunks: DataFrame, document_id: str) -> DataFrame:
    """The document with its ordered sections, each with the number and tokens of its chunks; no row if there is none."""
    s = sections.where(F.col("document_id") == document_id)
    n = chunks.join(s.select(F.col("id").alias("section_id")), "section_id").groupBy("section_id").agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("token_count"))
    rows = s.join(n, s["id"] == n["section_id"], "left")
    entry = F.struct("section_order", "id", "section_title", "heading_level", "heading_path", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("token_count", F.lit(0)).alias("token_count"))
    by = rows.groupBy("document_id").agg(F.sort_array(F.collect_list(entry)).alias("sections"), F.sum(F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"), F.sum(F.coalesce("token_count", F.lit(0))).alias("token_count"))
    return documents.where(F.col("id") == document_id).join(by.withColumnRenamed("document_id", "id"), "id", "left")
