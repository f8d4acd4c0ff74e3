"""Profiles of document streams.

The per-path aggregates of the batch engine are plain aggregations, so they run on a stream as they are. State grows with the number of paths and,
for value counts, of distinct values; an event-time window with a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators import flatten, stats


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, doc) from files of JSON lines as they arrive in a folder. doc_id is a hash of file, place and text: stable when a batch is repeated."""
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.select(F.xxhash64("file", "block", "value").alias("doc_id"), F.try_parse_json("value").alias("doc"))


def running_path_counts(docs: DataFrame, depth: int, config: EngineConfig | None = None) -> DataFrame:
    """path, kind, count, null_count over all documents so far (output mode complete or update)."""
    return stats.path_counts(flatten.flatten(docs, config, depth))


def windowed_path_counts(docs: DataFrame, depth: int, time: str, window: str, late: str, config: EngineConfig | None = None) -> DataFrame:
    """Counts of typed paths in event-time windows.

    ``time`` is the variant path of each document's timestamp text; documents later than ``late`` are left out, and finished windows leave the state.
    """
    stamped = docs.withColumn("at", F.expr(f"try_variant_get(doc, '{time}', 'string')").try_cast("timestamp")).withWatermark("at", late)
    nodes = flatten.flatten(stamped, config, depth, keep=("at",))
    return nodes.groupBy(F.window("at", window), "typed_path").agg(F.count("*").alias("count"))


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keeps the running result as the in-memory table ``name``."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
