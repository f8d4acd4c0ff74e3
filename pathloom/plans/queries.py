"""The registered queries of the profiling engine: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, Prune, StatType
from ..functions import metrics
from ..operators import enum_arrays, flatten, histogram, prune, stats
from ..sources import documents
from ..tables import shared_folder, spread, written
from . import estimate, experiment, fixtures, truth

Query = Callable[[SparkSession, str], DataFrame]

BINS = 16
PRUNED = "orders"
MIN_FREQ, MAX_PATHS, MAX_PREFIX = 0.5, 12, 2
RATE = 0.5

#: (op, path, operand) over the collection of events, and over the one with mixed types and with arrays.
PREDICATES = {
    "events": [
        ("exists", "props_obj.k", None), ("not_null", "props_obj.k", None), ("is_null", "props_obj.k", None), ("exists", "none", None), ("not_null", "none", None),
        ("is_null", "none", None), ("eq", "event_type_str", "click"), ("eq", "event_type_str", "zzz"), ("eq", "user_id_num", 10), ("eq", "user_id_num", -1), ("eq", "value_num", 4.29),
        ("eq", "value_num", 33.33), ("eq", "none_num", 3), ("eq", "none_str", "a"), ("eq", "none_bool", True), ("gt", "user_id_num", 100), ("gt", "user_id_num", -5), ("gt", "user_id_num", 5000),
        ("gt", "value_num", 50.5), ("gt", "props_obj.k_num", 98), ("gt", "none_num", 1), ("lt", "user_id_num", 20), ("lt", "user_id_num", -5), ("lt", "user_id_num", 5000),
        ("lt", "value_num", 50.5), ("lt", "props_obj.k_num", 1), ("lt", "none_num", 1), ("range", "event_id_num", (100, 400)), ("range", "value_num", (5, 100)), ("range", "value_num", (-9, -1)),
        ("range", "none_num", (1, 2)), ("gt", "event_type_str", 3), ("lt", "props_obj", 3),
    ],
    "mixed": [
        ("exists", "x", None), ("is_null", "x", None), ("not_null", "x", None), ("exists", "x_num", None), ("eq", "x_bool", True), ("eq", "x_bool", False), ("eq", "x_num", 1.5), ("eq", "x_num", 8),
        ("eq", "x_num", 4444), ("eq", "x_str", "click"), ("eq", "x_arr.0_num", 3), ("eq", "x_obj.k_num", 2), ("gt", "x_obj.k_num", 2), ("lt", "x_obj.k_num", 2), ("gt", "x_num", 10), ("lt", "x_num", 10),
    ],
    "orders": [
        ("memberof", "flags_arr", "A"), ("memberof", "flags_arr", "Z"), ("memberof", "lines_arr", 1), ("memberof", "lines_arr", 77), ("memberof", "none_arr", 1), ("memberof", "items_arr", 1),
        ("contains", "flags_arr", ["A", "R"]), ("contains", "flags_arr", ["N"]), ("contains", "flags_arr", []), ("contains", "lines_arr", [1, 2, 2]), ("contains", "none_arr", [1]), ("contains", "none_arr", []),
        ("overlaps", "flags_arr", ["A", "R"]), ("overlaps", "lines_arr", [1, 7]), ("overlaps", "lines_arr", []), ("overlaps", "none_arr", ["a"]),
    ],
}


def nodes(spark: SparkSession, sf_dir: str, name: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    docs, depth = fixtures.collection(spark, sf_dir, name)
    return flatten.flatten(docs, None, depth, kinds=kinds)


def bucket_rows(found: DataFrame) -> DataFrame:
    rows = found.select("path", "hist_type", F.posexplode("buckets").alias("pos", "b"))
    return rows.select("path", "hist_type", "pos", "b.num", "b.str", "b.bool", F.col("b.count").alias("cnt"), F.col("b.ndv").alias("ndv"))


def stat_rows(found: DataFrame) -> DataFrame:
    """Statistics without nested columns."""
    return found.select(
        "path", F.col("count").alias("cnt"), "null_count", "min_num", "max_num", "min_str", "max_str", "min_bool", "max_bool", "ndv",
        F.col("mode.num_val").alias("mode_num"), F.col("mode.str_val").alias("mode_str"), F.col("mode.bool_val").alias("mode_bool"), F.col("mode.count").alias("mode_cnt"),
    )


def path_inventory(name: str) -> Query:
    return lambda spark, d: flatten.path_inventory(nodes(spark, d, name))


def basic_stats(name: str) -> Query:
    return lambda spark, d: stat_rows(stats.key_stats(nodes(spark, d, name), EngineConfig(StatType.BASIC))).drop("ndv", "mode_num", "mode_str", "mode_bool", "mode_cnt")


def exact_ndv(name: str) -> Query:
    return lambda spark, d: stats.distinct_counts(stats.value_counts(nodes(spark, d, name)))


def mode(name: str) -> Query:
    return lambda spark, d: stat_rows(stats.key_stats(nodes(spark, d, name), EngineConfig(StatType.NDV_WITH_MODE))).where("mode_cnt is not null").select("path", "ndv", "mode_num", "mode_str", "mode_bool", "mode_cnt")


def buckets(name: str, bins: int = BINS) -> Query:
    return lambda spark, d: bucket_rows(histogram.histograms(written(stats.value_counts(nodes(spark, d, name))), bins))


def streamed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-height histograms by the path for very many distinct values."""
    return bucket_rows(histogram.histograms(written(stats.value_counts(nodes(spark, sf_dir, "events"))), BINS, fold_most=0))


def hll_bound(name: str) -> Query:
    """Whether each estimate of distinct values is within five times the standard error that was asked for."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        own = nodes(spark, d, name)
        values = written(stats.value_counts(own))
        both = stats.distinct_counts(values).join(stats.hll_counts(values, 0.05).withColumnRenamed("ndv", "guess"), "path")
        return both.select("path", (F.abs(F.col("guess") - F.col("ndv")) <= F.greatest(F.lit(1), 0.25 * F.col("ndv"))).alias("within"))

    return run


def confusion(name: str) -> Query:
    return lambda spark, d: flatten.type_confusion(nodes(spark, d, name))


def key_paths(name: str) -> Query:
    """Key paths made of the untyped paths alone."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = nodes(spark, d, name).select("json_path", "kind").distinct()
        shown = rows.select(flatten.json_path_to_key_path(F.col("json_path"), F.col("kind")).alias("typed_path"), flatten.json_path_to_base_path(F.col("json_path")).alias("base_path"))
        return shown.distinct()

    return run


def enum_counts(name: str) -> Query:
    return lambda spark, d: stat_rows(enum_arrays.enum_stats(nodes(spark, d, name, ("arr",)), EngineConfig(StatType.NDV_WITH_MODE))).select("path", "cnt", "ndv", "mode_num", "mode_str", "mode_cnt")


def enum_buckets(name: str, bins: int) -> Query:
    return lambda spark, d: bucket_rows(enum_arrays.enum_stats(nodes(spark, d, name, ("arr",)), EngineConfig(buckets=bins)).where("buckets is not null"))


def enum_hll(name: str) -> Query:
    """Like ``hll_bound``, for the distinct elements of arrays."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        arrays = written(nodes(spark, d, name, ("arr",)))
        exact, sketched = (enum_arrays.enum_stats(arrays, EngineConfig(k)) for k in (StatType.BASIC_NDV, StatType.NDV_HYPERLOG))
        both = exact.select("path", "ndv").join(sketched.select("path", F.col("ndv").alias("guess")), "path")
        return both.select("path", (F.abs(F.col("guess") - F.col("ndv")) <= F.greatest(F.lit(1), 0.25 * F.col("ndv"))).alias("within"))

    return run


def sampled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, depth = fixtures.collection(spark, sf_dir, "events")
    config = EngineConfig(StatType.BASIC_NDV, sampling_rate=RATE)
    return stat_rows(experiment.build(docs, config, depth)[0]).select("path", "cnt", "null_count", "min_num", "max_num", "ndv")


def pruned(*strategies: Prune) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, depth = fixtures.collection(spark, d, PRUNED)
        config = EngineConfig(StatType.BASIC, prune=frozenset(strategies), min_freq=MIN_FREQ, max_paths=MAX_PATHS, max_prefix=MAX_PREFIX)
        return experiment.build(docs, config, depth)[0].select("path", F.col("count").alias("cnt"), "null_count")

    return run


def meta(*strategies: Prune) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, depth = fixtures.collection(spark, d, PRUNED)
        return experiment.build(docs, EngineConfig(StatType.BASIC, prune=frozenset(strategies), min_freq=MIN_FREQ, max_paths=MAX_PATHS), depth)[1]

    return run


def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every full path, the stored path that a lookup finds after pruning to unique suffixes."""
    docs, depth = fixtures.collection(spark, sf_dir, PRUNED)
    config = EngineConfig(StatType.BASIC, prune=frozenset({Prune.UNIQUE_SUFFIX}))
    full = stats.path_counts(flatten.flatten(docs, None, depth)).select("path")
    return prune.lookup_paths(full, experiment.build(docs, config, depth)[0], config)


def estimates(name: str, kind: StatType, rate: float = 0.0, *strategies: Prune) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, depth = fixtures.collection(spark, d, name)
        config = EngineConfig(kind, rate, buckets=BINS, enum_arrays=name == "orders", prune=frozenset(strategies), min_freq=MIN_FREQ, max_paths=8)
        built = experiment.build(docs, config, depth)
        return estimate.estimates(estimate.predicate_frame(spark, PREDICATES[name]), *built, config)

    return run


def hll_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each estimate from sketched distinct counts is as near to that from exact ones as five times the sketch's error allows."""
    exact, sketched = (estimates("events", k)(spark, sf_dir) for k in (StatType.BASIC_NDV, StatType.NDV_HYPERLOG))
    both = exact.join(sketched.select("pred_id", F.col("estimate").alias("guess")), "pred_id")
    near = F.abs(F.col("guess") - F.col("estimate")) <= 1 + F.col("estimate") / 3
    return both.select("pred_id", F.coalesce(near, F.col("guess").eqNullSafe(F.col("estimate"))).alias("within"))  # both null: not to be estimated


def truths(name: str, per_path: int = 25) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = truth.collected(nodes(spark, d, name))
        preds = truth.predicates(own, per_path)
        els = F.array_join(F.expr(f"transform(els, x -> {truth._TAG})"), ",").alias("els")
        return preds.join(truth.truths(preds, own), "pred_id").select("op", "json_path", "num", "str", "bool", els, "truth")

    return run


def array_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of the array predicates and of ranges."""
    rows = [*PREDICATES["orders"], ("range", "o_totalprice_num", (1000, 150000)), ("contains", "flags_arr", ["A", "N", "R"]), ("overlaps", "flags_arr", ["Z"])]
    preds = estimate.predicate_frame(spark, rows).withColumn("json_path", F.regexp_replace("path", "_(arr|num)$", ""))
    docs, depth = fixtures.collection(spark, sf_dir, "orders")
    asked = {re.sub("_(arr|num)$", "", path) for _, path, _ in rows}  # only nodes at these paths are looked at
    return preds.join(truth.truths(preds, flatten.flatten(docs, None, depth, paths=asked)), "pred_id").select("pred_id", "op", "path", "truth")


def end_to_end(kind: StatType) -> Query:
    """Truth and estimate of every predicate of the events, and their errors by operator."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        docs, depth = fixtures.collection(spark, d, "events")
        return metrics.operator_summary(experiment.results(flatten.flatten(docs, None, depth), docs, EngineConfig(kind), depth))

    return run


def made_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of truth and estimate to hold the metrics against SQL."""
    rows = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    size = F.col("l_extendedprice")
    return rows.select(
        F.col("l_returnflag").alias("op"), F.col("l_linestatus").alias("config_id"), F.concat("l_returnflag", "l_linestatus").alias("path"),
        F.when(F.col("l_linenumber") == 3, 0).otherwise(F.col("l_quantity").cast("bigint")).cast("bigint").alias("truth"), F.when(size < 2000, 0).otherwise(F.floor(size / 1000)).cast("bigint").alias("estimate"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def point_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names: dict[str, Callable[..., Column]] = {
        "absolute": metrics.absolute_error, "relative": metrics.relative_error, "by_smaller": metrics.min_error, "symmetric": metrics.symmetric_relative_error,
        "symmetric_alt": metrics.symmetric_relative_error_alt, "log_relative": metrics.log_relative_error, "log_absolute": metrics.log_absolute_error, "squared": metrics.squared_error,
    }
    rows = made_results(spark, sf_dir).select("op", *(f("truth", "estimate").alias(k) for k, f in names.items()))
    return _rounded(rows.groupBy("op").agg(*(F.sum(k).alias(k) for k in names)))


def error_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made_results(spark, sf_dir)
    sizes = rows.groupBy("config_id").agg(F.count("*").alias("stats_bytes"))
    return _rounded(metrics.error_by_size(rows, sizes))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made_results(spark, sf_dir).withColumn("x", F.round(metrics.log_relative_error("truth", "estimate"), 6))
    return _rounded(metrics.trimmed(rows, "x", 0.05, 0.95).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))


def distinct_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values at single paths, read straight from the documents."""
    docs, _ = fixtures.collection(spark, sf_dir, "orders")
    paths = {"customer": (["customer", "c_custkey"], "bigint"), "region": (["customer", "nation", "region", "r_name"], "string"), "first": (["items", 0, "l_quantity"], "double"), "none": (["items", 99, "x"], "string")}
    found = [flatten.distinct_at(docs, *p).select(F.lit(n).alias("name"), "ndv") for n, p in paths.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _fields(docs: DataFrame, **kinds: str) -> DataFrame:
    return docs.select(*(F.try_variant_get("doc", f"$.{name}", kind).alias(name) for name, kind in kinds.items()))


CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string"}


def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON lines and read back as documents."""
    folder = shared_folder(spark)
    spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.to_json(F.struct(*CUSTOMER)).alias("value")).write.text(folder)
    return _fields(documents.json_lines(spark, folder), **CUSTOMER)


def source_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, of which there are few, written as one JSON array and read back as documents."""
    folder = shared_folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    rows.write.text(folder)
    return _fields(documents.json_array(spark, folder), n_nationkey="bigint", n_name="string", n_regionkey="bigint")


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as CSV: numbers become numbers, except in a column named like an id; a list stands in quotes."""
    folder = shared_folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal", F.col("s_nationkey").alias("nation_id"), F.format_string("['%s', 'n%s']", "s_name", "s_nationkey").alias("tags"))
    rows.write.csv(folder, header=True, escape='"')
    docs = documents.csv_documents(spark, folder, lists=("tags",))
    shown = _fields(docs, s_suppkey="bigint", s_name="string", s_acctbal="double", nation_id="string")
    types = docs.select(F.schema_of_variant(F.try_variant_get("doc", "$.nation_id", "variant")).alias("id_type"), F.try_variant_get("doc", "$.tags[1]", "string").alias("second_tag"), F.try_variant_get("doc", "$.s_suppkey", "bigint").alias("s_suppkey"))
    return shown.join(types, "s_suppkey")


def source_json_in_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON behind four columns of CSV and read back."""
    folder = shared_folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows.select(F.concat_ws(",", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", F.to_json(F.struct(*CUSTOMER))).alias("value")).write.text(folder)
    spark.createDataFrame([("key,nation,balance,segment,doc",)], "value string").write.mode("append").text(folder)
    return _fields(documents.json_in_csv(spark, folder), **CUSTOMER)


def source_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred documents, as the source's own rule has it."""
    return documents.first_documents(fixtures.collection(spark, sf_dir, "events")[0], 100).select("doc_id")


def sink_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written as JSON and read back."""
    folder = shared_folder(spark)
    docs, depth = fixtures.collection(spark, sf_dir, "events")
    found, about = experiment.build(docs, EngineConfig(StatType.BASIC), depth)
    documents.write_stats(found, about, folder)
    back = spark.read.schema(found.schema).json(f"{folder}/stats")
    return stat_rows(back).drop("ndv", "mode_num", "mode_str", "mode_bool", "mode_cnt")


def made_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``made_results`` with settings of configurations."""
    flag = F.col("config_id") == "F"
    return made_results(spark, sf_dir).select(
        "*", F.when(flag, "MIN_FREQ").otherwise("MAX_NO_PATHS").alias("prune"), F.when(F.col("truth") % 2 == 0, 0.01).otherwise(0.003).alias("min_freq"),
        F.when(F.col("op") == "A", "BASIC").otherwise("HISTOGRAM").alias("stats_type"), (F.col("truth") % 3).alias("buckets"),
    )


QUERIES: dict[str, Query] = {
    **{f"path_inventory_{n}": path_inventory(n) for n in fixtures.FIXTURES},
    **{f"basic_stats_{n}": basic_stats(n) for n in fixtures.FIXTURES},
    **{f"exact_ndv_{n}": exact_ndv(n) for n in ("events", "mixed", "orders")},
    **{f"mode_{n}": mode(n) for n in ("events", "mixed", "labels")},
    **{f"histogram_{n}": buckets(n) for n in ("events", "mixed", "labels", "orders")},
    "histogram_plus_labels": buckets("labels", 5),
    "histogram_streamed_events": streamed_buckets,
    **{f"hll_bound_{n}": hll_bound(n) for n in ("events", "orders")},
    **{f"type_confusion_{n}": confusion(n) for n in ("mixed", "labels")},
    "key_paths_convs": key_paths("convs"),
    **{f"enum_counts_{n}": enum_counts(n) for n in ("orders", "convs")},
    "enum_histogram_orders": enum_buckets("orders", 4),
    "enum_histogram_convs": enum_buckets("convs", 8),
    "sampled_stats_events": sampled_stats,
    "prune_min_freq": pruned(Prune.MIN_FREQ),
    "prune_no_typed_inner_nodes": pruned(Prune.NO_TYPED_INNER_NODES),
    "prune_max_no_paths": pruned(Prune.MAX_NO_PATHS),
    "prune_unique_suffix": pruned(Prune.UNIQUE_SUFFIX),
    "prune_max_prefix_length": pruned(Prune.MAX_PREFIX_LENGTH),
    "suffix_lookup": suffix_lookup,
    "meta_min_freq": meta(Prune.MIN_FREQ),
    "meta_max_no_paths": meta(Prune.MIN_FREQ, Prune.MAX_NO_PATHS),
    **{f"estimate_events_{k.value.lower()}": estimates("events", k) for k in StatType if k is not StatType.NDV_HYPERLOG},
    **{f"estimate_mixed_{k.value.lower()}": estimates("mixed", k) for k in StatType if k is not StatType.NDV_HYPERLOG},
    **{f"estimate_arrays_{k.value.lower()}": estimates("orders", k) for k in StatType if k is not StatType.NDV_HYPERLOG},
    "estimate_events_hll": estimates("events", StatType.NDV_HYPERLOG),
    "estimate_events_sampled": estimates("events", StatType.HISTOGRAM, RATE),
    "estimate_events_pruned": estimates("events", StatType.BASIC_NDV, 0.0, Prune.MAX_NO_PATHS),
    **{f"truth_{n}": truths(n) for n in ("events", "mixed", "labels")},
    "truth_arrays": array_truths,
    "error_summary_histogram": end_to_end(StatType.HISTOGRAM),
    "metric_points": point_metrics,
    "metric_means": lambda s, d: _rounded(metrics.mean_summary(made_results(s, d))),
    "metric_operator_summary": lambda s, d: _rounded(metrics.operator_summary(made_results(s, d))),
    "metric_robust_log": lambda s, d: _rounded(metrics.robust_log_error(made_results(s, d))),
    "metric_paired": lambda s, d: _rounded(metrics.paired(made_results(s, d), "config_id", "F", "O", "op")),
    "metric_high_errors": lambda s, d: _rounded(metrics.high_errors(made_results(s, d), 5.0)),
    "metric_error_histogram": lambda s, d: _rounded(metrics.error_histogram(made_results(s, d), 0.5, "op")),
    "metric_error_by_size": error_by_size,
    "metric_trimmed": trimmed,
    "metric_combined": lambda s, d: _rounded(metrics.combined(made_results(s, d), ("A",), "config_id")),
    "metric_filtered": lambda s, d: metrics.filtered(made_results(s, d), op="R", config_id="*").groupBy("op", "config_id").agg(F.count("*").alias("n")),
    "metric_pruning_comparison": lambda s, d: _rounded(metrics.pruning_comparison(made_settings(s, d), "MIN_FREQ", "min_freq")),
    "metric_bucket_comparison": lambda s, d: _rounded(metrics.bucket_comparison(made_settings(s, d))),
    "metric_matching": lambda s, d: metrics.matching(made_settings(s, d), op=("A", "N"), config_id="*", prune="MIN_FREQ", buckets=None).groupBy("op", "config_id").agg(F.count("*").alias("n")),
    "distinct_at_paths": distinct_at,
    **{f"enum_hll_{n}": enum_hll(n) for n in ("orders", "convs")},
    "estimate_events_hll_bound": hll_estimates,
    "source_json_lines": source_json_lines,
    "source_json_array": source_json_array,
    "source_csv": source_csv,
    "source_json_in_csv": source_json_in_csv,
    "source_first_documents": source_first,
    "sink_stats_events": sink_stats,
}
