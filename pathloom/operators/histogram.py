"""Histograms of value counts.

* SINGLETON: at most ``bins`` distinct values, one bucket each, ascending.
* SINGLETON_PLUS (strings with more): values above the share 1/bins, ascending, and one bucket for the remainder.
* EQUI_HEIGHT (numbers with more): ascending; a bucket closes once it holds ceil(n / bins) and the value changes.

The equi-height rule is a fold over sorted values. It runs as a higher-order function up to ``FOLD_MOST`` distinct values of a path; beyond that
the values are sorted by the shuffle and streamed, so that no path's values are gathered in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLD_MOST = 100_000

_BUCKET = "struct<num:double,str:string,bool:boolean,count:bigint,ndv:bigint>"


def _bucket(ndv=None):
    return F.struct(
        F.col("num_val").alias("num"), F.col("str_val").alias("str"), F.col("bool_val").alias("bool"), F.col("cnt").alias("count"), F.lit(ndv).cast("bigint").alias("ndv")
    )


def histograms(values: DataFrame, bins: int, singleton_plus: bool = True, fold_most: int = FOLD_MOST) -> DataFrame:
    """path, hist_type, buckets; paths without a histogram have no row."""
    # numbers that differ only beyond double precision stay apart in NDV; a histogram works on doubles
    totals = values.groupBy("path").agg(F.sum("cnt").alias("n"), F.count("*").alias("ndv"))
    rows = values.join(totals, "path")
    few = rows.where(F.col("ndv") <= bins)
    out = few.groupBy("path").agg(F.sort_array(F.collect_list(_bucket())).alias("buckets")).select("path", F.lit("SINGLETON").alias("hist_type"), "buckets")
    if singleton_plus:
        out = out.unionByName(singleton_plus_histograms(rows, bins))
    many = rows.where((F.col("ndv") > bins) & (F.col("kind") == "num"))
    out = out.unionByName(equi_height_folded(many.where(F.col("ndv") <= fold_most), bins))
    return out.unionByName(equi_height_streamed(many.where(F.col("ndv") > fold_most), bins))


def singleton_plus_histograms(rows: DataFrame, bins: int) -> DataFrame:
    """At most ``bins`` values of a path can pass, so what is gathered is small."""
    own = rows.where((F.col("ndv") > bins) & (F.col("kind") == "str") & (F.col("cnt") * bins > F.col("n")))
    kept = own.groupBy("path", "n", "ndv").agg(F.sort_array(F.collect_list(_bucket())).alias("kept"), F.sum("cnt").alias("sum"))
    rest = F.struct(
        F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"),
        (F.col("n") - F.col("sum")).alias("count"), (F.col("ndv") - F.size("kept")).cast("bigint").alias("ndv"),
    )
    return kept.select("path", F.lit("SINGLETON_PLUS").alias("hist_type"), F.concat("kept", F.array(rest)).cast(f"array<{_BUCKET}>").alias("buckets"))


def equi_height_folded(rows: DataFrame, bins: int) -> DataFrame:
    """The open bucket is the last of the array; it is closed when it has reached the target and the next value comes."""
    pairs = rows.groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("num_val", "cnt"))).alias("pairs"))
    target = F.ceil(F.col("n") / bins)
    nothing = F.array().cast(f"array<{_BUCKET}>")

    def bucket(num, count, ndv):
        return F.struct(num.alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"), count.cast("bigint").alias("count"), ndv.cast("bigint").alias("ndv"))

    def step(state, x):
        full = state["count"] >= target
        closed = F.when(full, F.array_append(state["done"], bucket(state["num"], state["count"], state["ndv"]))).otherwise(state["done"])
        return F.struct(
            closed.alias("done"), x["num_val"].alias("num"), (F.when(full, 0).otherwise(state["count"]) + x["cnt"]).cast("bigint").alias("count"),
            (F.when(full, 0).otherwise(state["ndv"]) + 1).cast("bigint").alias("ndv"),
        )

    start = F.struct(nothing.alias("done"), F.lit(None).cast("double").alias("num"), F.lit(0).cast("bigint").alias("count"), F.lit(0).cast("bigint").alias("ndv"))
    folded = F.aggregate("pairs", start, step, lambda s: F.array_append(s["done"], bucket(s["num"], s["count"], s["ndv"])))
    return pairs.select("path", F.lit("EQUI_HEIGHT").alias("hist_type"), folded.alias("buckets"))


def equi_height_streamed(rows: DataFrame, bins: int) -> DataFrame:
    """The same fold for paths with very many distinct values: a row of memory for each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, done, top, count, ndv, target = None, [], None, 0, 0, 0

        def result() -> pa.RecordBatch:
            buckets = [*done, {"num": top, "str": None, "bool": None, "count": count, "ndv": ndv}]
            kind = pa.list_(pa.struct([("num", pa.float64()), ("str", pa.string()), ("bool", pa.bool_()), ("count", pa.int64()), ("ndv", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array(["EQUI_HEIGHT"]), pa.array([buckets], kind)], names=["path", "hist_type", "buckets"])

        for batch in batches:
            for p, n, value, cnt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path:
                    if path is not None:
                        yield result()
                    path, done, count, ndv, target = p, [], 0, 0, -(-n // bins)
                elif count >= target:
                    done.append({"num": top, "str": None, "bool": None, "count": count, "ndv": ndv})
                    count = ndv = 0
                top, count, ndv = value, count + cnt, ndv + 1
        if path is not None:
            yield result()

    dealt = rows.select("path", "n", "num_val", "cnt").repartition("path").sortWithinPartitions("path", "num_val")
    return dealt.mapInArrow(run, f"path string, hist_type string, buckets array<{_BUCKET}>")


def frequency_histograms(values: DataFrame, bins: int) -> DataFrame:
    """For elements of enum arrays: all values by falling count, or the bins - 1 most frequent and a bucket for the rest.

    The rest's bucket has the count of the next value and the number of values that are left.
    """
    by_count = Window.partitionBy("path").orderBy(F.desc("cnt"), "num_val", "str_val", "bool_val")
    ranked = values.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= bins)
    total = values.groupBy("path").agg(F.count("*").alias("ndv"))
    ordered = ranked.join(total, "path").groupBy("path", "ndv").agg(F.sort_array(F.collect_list(F.struct("r", _bucket().alias("b")))).alias("all"))
    shown = F.transform("all", lambda x: x["b"])
    last = F.element_at("all", -1)["b"]
    rest = F.struct(F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"), last["count"].alias("count"), (F.col("ndv") - (bins - 1)).cast("bigint").alias("ndv"))
    small = F.col("ndv") <= bins
    return ordered.select(
        "path", F.when(small, "SINGLETON").otherwise("SINGLETON_PLUS").alias("hist_type"),
        F.when(small, shown).otherwise(F.concat(F.slice(shown, 1, bins - 1), F.array(rest))).cast(f"array<{_BUCKET}>").alias("buckets"),
    )
