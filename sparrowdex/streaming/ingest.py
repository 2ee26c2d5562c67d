"""Incremental reindexing: a stream of landed markdown files is upserted into the store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parsing import markdown
from ..plans.store import Store, ingest

SCHEMA = "source_path string, raw string, modified timestamp"


def follow(spark: SparkSession, landing: str, store: Store, checkpoint: str, max_tokens: int = 400, overlap_tokens: int = 60):
    """Start a query that ingests JSON lines (source_path, raw, modified) as they land; of a path that comes twice in a batch the latest counts.

    A batch that is replayed after a failure writes the same documents again, so the
    result is the same.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("source_path").agg(F.max(F.struct("modified", "raw")).alias("x")).select("source_path", "x.raw", "x.modified")
        if not latest.isEmpty():
            ingest(store, *markdown(latest), max_tokens, overlap_tokens, append=True)

    stream = spark.readStream.schema(SCHEMA).json(landing)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
