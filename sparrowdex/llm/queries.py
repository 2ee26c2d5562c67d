"""The registered queries of the subpackage and their SQL, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import quality as Q
from . import toxicity as X
from .embeddings import embedding_near_duplicates
from .fingerprints import document_fingerprints
from .licenses import license_scan
from .mixing import mixing_report
from .near_duplicates import near_duplicates
from .packing import pack
from .sharding import shard
from .sql import ORACLE_SQL  # noqa: F401
from .token_counts import token_counts


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read(spark, sf_dir, "labels").where(~C.held_out(F.col("doc_id")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    lexicon = X.learn(docs, training_labels(spark, sf_dir))
    return X.toxicity(docs, lexicon, threshold=0.7).withColumn("held_out", C.held_out(F.col("doc_id")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    views = Q.learn(docs, training_labels(spark, sf_dir))
    return Q.quality(docs, views, threshold=0.5).withColumn("held_out", C.held_out(F.col("doc_id")))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"), k=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(C.read(spark, sf_dir, "documents")).drop("spans")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"), C.tokenizer("word_bpe_49k.json"), length=4096, end=1)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(C.read(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(C.read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(C.read(spark, sf_dir, "documents"), shards=16)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(C.read(spark, sf_dir, "documents"), C.tokenizer("byte_bpe_50k.json"), limit=512)


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(C.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_license_scans": op4_license_scans,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_sharding": op8_sharding,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_token_counts": op10_token_counts,
}
