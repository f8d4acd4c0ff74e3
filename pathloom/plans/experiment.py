"""From documents to statistics, and from a grid of settings to results; with a cache of statistics in Parquet."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, Prune
from ..operators import enum_arrays, flatten, prune, stats
from ..tables import written
from . import estimate, truth


def build(docs: DataFrame, config: EngineConfig, depth: int | None = None, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key_stats, meta) of a collection (doc_id, doc). ``nodes`` of the sampled documents, or what ``truth.collected`` made of them, may be given."""
    chosen = flatten.sampled(docs, config)
    if nodes is None:
        nodes = flatten.flatten(chosen, config, depth)
    if Prune.MAX_PREFIX_LENGTH in config.prune:
        nodes = flatten.windowed(nodes, config)
    found = stats.key_stats(nodes, config)
    if config.enum_arrays:
        arrays = flatten.flatten(chosen, config, depth, kinds=("arr",)) if "arr" not in nodes.columns else nodes
        found = found.unionByName(enum_arrays.enum_stats(flatten.windowed(arrays, config) if Prune.MAX_PREFIX_LENGTH in config.prune and arrays is not nodes else arrays, config))
    found = written(found)  # a row a path; read by the pruning steps and the summary
    size = docs.agg(F.count("*").alias("collection_size"))
    stored, skipped = prune.prune(found, size, config)
    return stored, stats.summary(docs, config, found, stored, skipped)


def results(nodes: DataFrame, docs: DataFrame, config: EngineConfig, depth: int | None = None, per_path: int = 25) -> DataFrame:
    """op, path, truth, estimate for predicates over all paths; ``nodes`` are those of the whole collection."""
    nodes = truth.collected(nodes)
    stored, meta = build(docs, config, depth, None if config.sampling_rate else nodes)
    return _compared(nodes, stored, meta, config, per_path)


def _compared(collected: DataFrame, stored: DataFrame, meta: DataFrame, config: EngineConfig, per_path: int) -> DataFrame:
    preds = truth.predicates(collected, per_path)
    guess = estimate.estimates(preds, stored, meta, config)
    return guess.join(truth.truths(preds, collected), "pred_id").select("op", "path", "truth", "estimate")


class StatsCache:
    """Statistics by the settings they depend on: a folder for each key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, collection: str, config: EngineConfig) -> str:
        return f"{self.folder}/{collection}-{config.key()}"

    def put(self, collection: str, config: EngineConfig, built: tuple[DataFrame, DataFrame]) -> None:
        """Replaces what the same settings had."""
        for name, df in zip(("stats", "meta"), built, strict=True):
            df.write.mode("overwrite").parquet(f"{self._place(collection, config)}/{name}")

    def get(self, collection: str, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
        """Raises KeyError if these settings were not stored."""
        from pyspark.errors import AnalysisException

        place = self._place(collection, config)
        try:
            return self.spark.read.parquet(f"{place}/stats"), self.spark.read.parquet(f"{place}/meta")
        except AnalysisException as error:
            raise KeyError(place) from error

    def get_or_build(self, collection: str, docs: DataFrame, config: EngineConfig, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
        if not fresh:
            try:
                return self.get(collection, config)
            except KeyError:
                pass
        self.put(collection, config, build(docs, config))
        return self.get(collection, config)


def stats_size(stored: DataFrame) -> DataFrame:
    """Bytes of the statistics as JSON, nulls left out."""
    return stored.select(F.sum(F.octet_length(F.to_json(F.struct(*stored.columns)))).alias("stats_bytes"))


def run_grid(docs: DataFrame, configs: list[EngineConfig], folder: str, depth: int | None = None, per_path: int = 25) -> DataFrame:
    """All results with config_id and the settings, written under ``folder``. The collection's values are counted once.

    Also writes, for each configuration, the size of its statistics, the seconds that building them and estimating took, and the most memory that
    executions of its tasks held (``build_seconds``, ``estimate_seconds``, ``peak_bytes``) under ``folder``-sizes.
    """
    spark = docs.sparkSession
    depth = flatten.max_depth(docs) if depth is None else depth
    collected = truth.collected(flatten.flatten(docs, EngineConfig(), depth))
    for c in configs:
        began = time.perf_counter()
        place = f"{folder.rstrip('/')}/config_id={c.key()}"
        stored, meta = build(docs, c, depth, None if c.sampling_rate else collected)
        stored, meta = written(stored), written(meta)
        built = time.perf_counter()
        preds = truth.predicates(collected, per_path)
        estimate.estimates(preds, stored, meta, c).write.format("noop").mode("overwrite").save()
        guessed = time.perf_counter()
        kept = {"stats_type": c.stats_type.value, "sampling_rate": c.sampling_rate, "prune": ",".join(sorted(p.value for p in c.prune)), "buckets": c.buckets, "min_freq": c.min_freq, "max_paths": c.max_paths}
        _compared(collected, stored, meta, c, per_path).withColumns({k: F.lit(v) for k, v in kept.items()}).write.mode("overwrite").parquet(place)
        size = stats_size(stored).withColumns({"build_seconds": F.lit(built - began), "estimate_seconds": F.lit(guessed - built), "peak_bytes": F.lit(peak_memory(spark)).cast("bigint")})
        size.write.mode("overwrite").parquet(f"{folder.rstrip('/')}-sizes/config_id={c.key()}")
    return spark.read.parquet(folder)


def peak_memory(spark: SparkSession) -> int | None:
    """The largest heap use of an executor (the driver, in local mode) that Spark's own metrics have seen; None before the first."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    peaks = (found.apply(k).peakMemoryMetrics() for k in range(found.size()))
    return max((p.get().getMetricValue("JVMHeapMemory") for p in peaks if p.isDefined()), default=None)
