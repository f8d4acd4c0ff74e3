"""Pruning of key-path statistics, applied in a fixed order.

All steps work on the table of statistics, one row a path; only the suffix search joins it with itself, on suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, Prune


def min_freq(stats: DataFrame, size: DataFrame, config: EngineConfig) -> DataFrame:
    """Paths that occur more than int(min_freq * collection_size) times; ``size`` has the one row collection_size."""
    least = F.floor(F.lit(config.min_freq) * F.col("collection_size").cast("double"))
    return stats.crossJoin(F.broadcast(size)).where(F.col("count") > least).drop("collection_size")


def no_typed_inner_nodes(stats: DataFrame) -> DataFrame:
    """Without paths whose text ends with arr or obj; keys that end so go too."""
    return stats.where(~F.endswith("path", F.lit("arr")) & ~F.endswith("path", F.lit("obj")))


def max_paths(stats: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """The ``max_paths`` most frequent paths; and the count of the first that is left out, if any (one row or none)."""
    order = F.desc("count"), F.asc("path")
    top = stats.orderBy(*order).limit(config.max_paths)
    next_one = stats.select("count", "path").orderBy(*order).limit(config.max_paths + 1)
    skipped = next_one.agg(F.count("*").alias("n"), F.min("count").alias("highest_count_skipped")).where(F.col("n") > config.max_paths).select("highest_count_skipped")
    return top, skipped


def suffixes(path: Column, config: EngineConfig) -> Column:
    """All component suffixes of a path, the longest (the path itself) first."""
    parts = F.split(path, f"\\Q{config.key_sep}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), config.key_sep))


def unique_suffix(stats: DataFrame, config: EngineConfig) -> DataFrame:
    """Each path becomes its shortest proper suffix with which no other path ends (as text), or stays.

    A text suffix of another path starts anywhere in it, so every path is expanded to all its text suffixes once, which are then counted: one
    aggregation instead of a comparison of all pairs of paths.
    """
    paths = stats.select("path").distinct()
    own = paths.select("path", F.posexplode(suffixes(F.col("path"), config)).alias("k", "suffix")).where("k > 0")
    texts = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda k: F.substring(F.col("path"), k, F.length("path")))).alias("suffix"))
    alone = texts.groupBy("suffix").agg(F.count("*").alias("n")).where("n = 1").select("suffix")
    best = own.join(alone, "suffix").groupBy("path").agg(F.max_by("suffix", "k").alias("short"))
    return stats.join(best, "path", "left").withColumn("path", F.coalesce("short", "path")).drop("short")


def prune(stats: DataFrame, size: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """The kept statistics, and one row highest_count_skipped.

    That is the count of the first path left out by MAX_NO_PATHS, else the MIN_FREQ threshold, else 0.
    """
    own = config.prune
    least = F.floor(F.lit(config.min_freq) * F.col("collection_size").cast("double")) if Prune.MIN_FREQ in own else F.lit(0)
    skipped = size.select(least.cast("bigint").alias("highest_count_skipped"))
    if Prune.MIN_FREQ in own:
        stats = min_freq(stats, size, config)
    if Prune.NO_TYPED_INNER_NODES in own:
        stats = no_typed_inner_nodes(stats)
    if Prune.MAX_NO_PATHS in own:
        stats, first = max_paths(stats, config)
        first = first.agg(F.max("highest_count_skipped").alias("first"))
        skipped = skipped.crossJoin(F.broadcast(first)).select(F.coalesce("first", "highest_count_skipped").alias("highest_count_skipped"))
    if Prune.UNIQUE_SUFFIX in own:
        stats = unique_suffix(stats, config)
    return stats, skipped


def lookup_paths(paths: DataFrame, stats: DataFrame, config: EngineConfig) -> DataFrame:
    """path, stored: the longest suffix of each path among the stored paths, else the path itself."""
    every = paths.select("path").distinct().select("path", F.posexplode(suffixes(F.col("path"), config)).alias("k", "suffix"))
    found = every.join(stats.select(F.col("path").alias("suffix")), "suffix", "left_semi").groupBy("path").agg(F.min_by("suffix", "k").alias("stored"))
    return paths.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("stored", "path").alias("stored"))

