"""Error metrics of estimates as column expressions, and summaries of results.

Point metrics take the truth and the estimate; aggregates are means and quantiles of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_one(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def absolute_error(t, e) -> Column:
    return F.abs(_d(t) - _d(e))


def relative_error(t, e) -> Column:
    """|t - e| by the truth, or by 1 if that is 0."""
    return absolute_error(t, e) / _or_one(_d(t))


def min_error(t, e) -> Column:
    """|t - e| by the smaller of both, or by 1 if that is 0."""
    return absolute_error(t, e) / _or_one(F.least(_d(t), _d(e)))


def symmetric_relative_error(t, e) -> Column:
    """From 0 to 2: |t - e| by the mean of both."""
    return F.when((_d(t) == 0) & (_d(e) == 0), 0.0).otherwise(F.try_divide(absolute_error(t, e), (_d(t) + _d(e)) / 2))


def symmetric_relative_error_alt(t, e) -> Column:
    """From 0 to 1: |t - e| by the sum of both."""
    return F.when((_d(t) == 0) & (_d(e) == 0), 0.0).otherwise(F.try_divide(absolute_error(t, e), _d(t) + _d(e)))


def log_relative_error(t, e) -> Column:
    """log10(e / t); one is added to both if e is 0, and t counts as 1 if 0."""
    shift = F.when(_d(e) == 0, 1.0).otherwise(0.0)
    return F.log10((_d(e) + shift) / _or_one(_d(t) + shift))


def log_absolute_error(t, e) -> Column:
    return F.log10(_or_one(absolute_error(t, e)))


def squared_error(t, e) -> Column:
    return (_d(t) - _d(e)) * (_d(t) - _d(e))


def means(t="truth", e="estimate") -> dict[str, Column]:
    """All mean metrics of a group."""
    sym = F.avg(symmetric_relative_error(t, e))
    return {
        "mse": F.avg(squared_error(t, e)), "rmse": F.sqrt(F.avg(squared_error(t, e))), "mean_absolute": F.avg(absolute_error(t, e)), "mean_min": F.avg(min_error(t, e)),
        "mean_log": F.avg(log_relative_error(t, e)), "mean_abs_log": F.avg(F.abs(log_relative_error(t, e))), "mare": F.avg(relative_error(t, e)),
        "smare": sym, "smare_alt": sym / 2, "mape": F.avg(relative_error(t, e)) * 100, "smape": sym * 100,
    }


def operator_summary(results: DataFrame, *by: str) -> DataFrame:
    """Mean, median, p90 and max of the relative error; median and p90 are elements of the sorted errors, not interpolated.

    The order statistic is found by counting equal errors, so the errors of a group are never gathered.
    """
    from pyspark.sql import Window

    by = by or ("op",)
    counted = results.withColumn("err", relative_error("truth", "estimate")).groupBy(*by, "err").agg(F.count("*").alias("cnt"))
    upto = F.sum("cnt").over(Window.partitionBy(*by).orderBy("err"))
    n = F.sum("cnt").over(Window.partitionBy(*by))
    ranked = counted.withColumn("upto", upto).withColumn("n", n)
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("err")))
    return ranked.groupBy(*by).agg(
        F.sum("cnt").alias("n"), (F.sum(F.col("err") * F.col("cnt")) / F.sum("cnt")).alias("mean"),
        F.min(F.when(F.col("upto") > F.expr("n div 2"), F.col("err"))).alias("median"), at(0.9).alias("p90"), F.max("err").alias("max"),
    )


def mean_summary(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*(by or ("op",))).agg(*(v.alias(k) for k, v in means().items()))


def robust_log_error(results: DataFrame, *by: str) -> DataFrame:
    """Median and 0.9 quantile of the absolute log error, interpolated."""
    err = F.abs(log_relative_error("truth", "estimate"))
    return results.groupBy(*(by or ("op",))).agg(F.percentile(err, 0.5).alias("median_abs_log"), F.percentile(err, 0.9).alias("p90_abs_log"))


def trimmed(results: DataFrame, value: str, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Without values at or above the high quantile, then without those at or below the low quantile of the rest."""
    top = results.agg(F.percentile(value, high).alias("__q"))
    rest = results.crossJoin(F.broadcast(top)).where(F.col(value) < F.col("__q")).drop("__q")
    bottom = rest.agg(F.percentile(value, low).alias("__q"))
    return rest.crossJoin(F.broadcast(bottom)).where(F.col(value) > F.col("__q")).drop("__q")


def matching(results: DataFrame, **settings) -> DataFrame:
    """Rows whose columns have the given values; '*' or None is any, a tuple any of its values."""
    for name, wanted in settings.items():
        if isinstance(wanted, tuple):
            results = results.where(F.col(name).isin(*wanted))
        elif wanted not in ("*", None):
            results = results.where(F.col(name) == wanted)
    return results


def error_histogram(results: DataFrame, width: float, *by: str) -> DataFrame:
    """Counts of log errors by bins of ``width``: what an error plot shows."""
    return results.groupBy(*by, (F.floor(log_relative_error("truth", "estimate") / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def high_errors(results: DataFrame, threshold: float) -> DataFrame:
    """The worst predicate of each path whose relative error reaches the threshold."""
    err = relative_error("truth", "estimate")
    return results.withColumn("err", err).where(F.col("err") >= threshold).groupBy("path").agg(F.max("err").alias("err"), F.count("*").alias("n"))


def paired(results: DataFrame, column: str, left: str, right: str, *on: str) -> DataFrame:
    """Mean absolute log error under two values of a setting, side by side."""
    value = mean_summary(results, column, *on).select(column, *on, "mean_abs_log", "mare")
    a = value.where(F.col(column) == left).select(*on, F.col("mean_abs_log").alias("left_log"), F.col("mare").alias("left_mare"))
    b = value.where(F.col(column) == right).select(*on, F.col("mean_abs_log").alias("right_log"), F.col("mare").alias("right_mare"))
    return a.join(b, list(on))


def error_by_size(results: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each configuration: the unweighted mean over operators of the mean relative error, with the size of its statistics."""
    by_op = results.groupBy("config_id", "op").agg(F.avg(relative_error("truth", "estimate")).alias("mare"))
    return by_op.groupBy("config_id").agg(F.avg("mare").alias("error")).join(sizes, "config_id")


def filtered(results: DataFrame, **settings) -> DataFrame:
    """Rows whose columns have the given values; '*' is any, and None matches nothing."""
    for name, wanted in settings.items():
        if wanted is None:
            return results.where(F.lit(False))
        if wanted != "*":
            results = results.where(F.col(name) == wanted)
    return results


def combined(results: DataFrame, without: tuple[str, ...], *by: str) -> DataFrame:
    """Log errors of all operators but some as one series for each group: count, mean, spread and quartiles."""
    err = log_relative_error("truth", "estimate")
    rows = results.where(~F.col("op").isin(*without)) if without else results
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(err).alias("mean"), F.stddev_pop(err).alias("spread"),
        F.percentile(err, 0.25).alias("q1"), F.percentile(err, 0.5).alias("q2"), F.percentile(err, 0.75).alias("q3"),
    )


def pruning_comparison(results: DataFrame, strategy: str, threshold: str) -> DataFrame:
    """Median and p90 of the absolute log error for each threshold of one pruning strategy, in the order of the threshold."""
    return robust_log_error(results.where(F.col("prune") == strategy), threshold, "op").orderBy(threshold, "op")


def bucket_comparison(results: DataFrame) -> DataFrame:
    """The same for each number of buckets and least frequency of histograms."""
    return robust_log_error(results.where("stats_type = 'HISTOGRAM'"), "buckets", "min_freq")
