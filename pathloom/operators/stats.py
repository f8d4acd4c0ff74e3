"""Per-path statistics in two aggregations: values of a path (``counted``), then the path.

Both aggregations combine before the shuffle; a hot path is as many rows in the second as it has distinct values. All but histograms come from
one such pass. Histograms read the values several times, so there the counts by value are a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, StatType
from ..tables import written
from . import histogram

VALUE = ("num_val", "num_exact", "str_val", "bool_val")
STAT_COLUMNS = (
    "path", "kind", "count", "null_count", "min_num", "max_num", "min_str", "max_str", "min_bool", "max_bool", "ndv", "mode", "hist_type", "buckets",
)


def counted(nodes: DataFrame) -> DataFrame:
    """typed_path, base_path, kind, the value in its column, cnt: one row for each value of a path, and one for each container or null path.

    All statistics of a build follow from this table.
    """
    if "cnt" in nodes.columns:  # truth.collected
        return nodes.groupBy("typed_path", "base_path", "kind", *VALUE).agg(F.sum("cnt").alias("cnt"))
    # -0.0 and 0.0 are one number
    rows = nodes.withColumn("num_val", F.when(F.col("num_val") == 0, 0.0).otherwise(F.col("num_val")))
    return rows.groupBy("typed_path", "base_path", "kind", *VALUE).agg(F.count("*").alias("cnt"))


def value_counts(nodes: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """path, kind, the value in its column, cnt: for numbers, strings and bools."""
    rows = (counted(nodes) if counts is None else counts).where(F.col("kind").isin("num", "str", "bool"))
    return rows.select(F.col("typed_path").alias("path"), "kind", *VALUE, "cnt")


def path_counts(nodes: DataFrame) -> DataFrame:
    """path, kind, count, null_count for base paths (kind null) and typed paths.

    A base path counts all occurrences, nulls among them; a typed path those of its type. Each node gives both rows before the shuffle.
    """
    both = nodes.select("kind", F.explode(F.array(
        F.struct(F.col("base_path").alias("path"), F.lit(None).cast("string").alias("k")),
        F.struct(F.when(F.col("kind") != "null", F.col("typed_path")).alias("path"), F.col("kind").alias("k")),
    )).alias("p")).where("p.path is not null")
    return both.groupBy(F.col("p.path").alias("path"), F.col("p.k").alias("kind")).agg(
        F.count("*").alias("count"), F.count_if((F.col("kind") == "null") & F.col("p.k").isNull()).alias("null_count")
    )


def ranges(values: DataFrame) -> DataFrame:
    """min and max by type, from ``value_counts``."""
    shown = {"num": "num_val", "str": "str_val", "bool": "bool_val"}
    return values.groupBy("path").agg(*(f(c).alias(f"{n}_{k}") for k, c in shown.items() for n, f in (("min", F.min), ("max", F.max))))


def distinct_counts(values: DataFrame) -> DataFrame:
    """Exact number of distinct values: an int and a float of the same value are one. Rows of ``values`` are distinct already."""
    return values.groupBy("path").agg(F.count("*").alias("ndv"))


def hll_counts(values: DataFrame, error: float) -> DataFrame:
    """Estimated number of distinct values (HyperLogLog++) from ``value_counts``; repeats do not change a sketch."""
    return values.groupBy("path").agg(F.approx_count_distinct(_shown(), error).alias("ndv"))


def _shown(place: str = "") -> Column:
    """A value as text."""
    num_val, num_exact, str_val, bool_val = (F.col(place + c) for c in VALUE)
    return F.coalesce(num_exact.cast("string"), num_val.cast("string"), str_val, bool_val.cast("string"))


def modes(values: DataFrame) -> DataFrame:
    """Most frequent value with its count; of several the smallest."""
    value = F.struct("num_val", "str_val", "bool_val", F.col("cnt").alias("count"))
    top = values.groupBy("path").agg(F.max("cnt").alias("top"))
    tied = values.join(top, "path").where("cnt = top")
    return tied.groupBy("path").agg(F.min_by(value, F.struct("num_val", "str_val", "bool_val")).alias("mode"))


def key_stats(nodes: DataFrame, config: EngineConfig) -> DataFrame:
    """STAT_COLUMNS for every base and typed path of the given nodes."""
    kind = config.stats_type
    counts = counted(nodes)
    if kind is StatType.HISTOGRAM:
        counts = written(counts)  # read by several aggregations
    # A row for the base path, without its value, and one for the typed path.
    value = F.struct(*VALUE)
    both = counts.select("kind", "cnt", F.explode(F.array(
        F.struct(F.col("base_path").alias("path"), F.lit(None).cast("string").alias("k"), F.when(F.lit(False), value).alias("v")),
        F.struct(F.when(F.col("kind") != "null", F.col("typed_path")).alias("path"), F.col("kind").alias("k"), F.when(F.col("kind").isin("num", "str", "bool"), value).alias("v")),
    )).alias("p")).where("p.path is not null").select("kind", "cnt", "p.*")
    null = (F.col("kind") == "null") & F.col("k").isNull()
    wanted = [F.sum("cnt").alias("count"), F.sum(F.when(null, F.col("cnt")).otherwise(0)).alias("null_count")]
    wanted += [f(f"v.{c}").alias(f"{n}_{t}") for t, c in (("num", "num_val"), ("str", "str_val"), ("bool", "bool_val")) for n, f in (("min", F.min), ("max", F.max))]
    if kind is StatType.NDV_HYPERLOG:
        wanted.append(F.approx_count_distinct(_shown("v."), config.hll_error).alias("ndv"))
    elif kind is not StatType.BASIC:
        wanted.append(F.count("v").alias("ndv"))  # rows of counts are distinct
    if kind is StatType.NDV_WITH_MODE:
        top = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("cnt")).alias("less"), "v.num_val", "v.str_val", "v.bool_val")))
        wanted.append(F.when(top.isNotNull(), F.struct(*(top[c].alias(c) for c in ("num_val", "str_val", "bool_val")), (-top["less"]).alias("count"))).alias("mode"))
    out = both.groupBy("path", F.col("k").alias("kind")).agg(*wanted)
    if kind is not StatType.BASIC:
        out = out.withColumn("ndv", F.when(F.col("ndv") > 0, F.col("ndv")))
    if kind is StatType.HISTOGRAM:
        out = out.join(histogram.histograms(value_counts(nodes, counts), config.buckets, config.singleton_plus), "path", "left")
    return conformed(out)


def conformed(stats: DataFrame) -> DataFrame:
    """All STAT_COLUMNS; what is not there is null. Values belong to typed paths: base paths have none."""
    missing = {"ndv": "bigint", "mode": MODE, "hist_type": "string", "buckets": BUCKETS, "min_num": "double", "max_num": "double", "min_str": "string", "max_str": "string", "min_bool": "boolean", "max_bool": "boolean"}
    stats = stats.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in stats.columns})
    values = {c: F.when(F.col("kind").isNotNull(), F.col(c)) for c in missing}
    return stats.withColumns(values).select(*STAT_COLUMNS)


MODE = "struct<num_val:double,str_val:string,bool_val:boolean,count:bigint>"
BUCKETS = "array<struct<num:double,str:string,bool:boolean,count:bigint,ndv:bigint>>"


def summary(docs: DataFrame, config: EngineConfig, found: DataFrame, stored: DataFrame, highest_skipped: DataFrame) -> DataFrame:
    """The row about a statistics build. ``collection_size`` counts all documents, sampled or not."""
    size = docs.agg(F.count("*").alias("collection_size"))
    counts = found.agg(F.count("*").alias("unique_key_paths_found")), stored.agg(F.count("*").alias("unique_key_paths_stored"))
    # single rows beside each other
    return size.crossJoin(F.broadcast(counts[0])).crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(highest_skipped)).withColumns(
        {"stats_type": F.lit(config.stats_type.value), "sampling_rate": F.lit(config.sampling_rate)}
    )
