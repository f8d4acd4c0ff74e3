"""Statistics of arrays whose elements are all strings, all integers or all bools: ``path[suffix]``.

The frequency of an element is the number of arrays that hold it. Sampled documents count here as everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig, StatType
from ..tables import written
from . import histogram, stats

#: Exact element types: an integer is a number without a fraction in its JSON text.
_EXACT = "case when t = 'STRING' then 'str' when t = 'BOOLEAN' then 'bool' when t = 'BIGINT' or t rlike '^DECIMAL[(](19|[23][0-9]),0[)]$' then 'num' end"


def candidates(nodes: DataFrame) -> DataFrame:
    """path (typed array path and element suffix), kind, elements: arrays that are not empty and of one exact type."""
    rows = nodes.where("kind = 'arr'").select("doc_id", "typed_path", F.expr("try_variant_get(arr, '$', 'array<variant>')").alias("e")).where("size(e) > 0")
    rows = rows.withColumn("kinds", F.expr(f"transform(transform(e, x -> schema_of_variant(x)), t -> {_EXACT})")).where("get(kinds, 0) is not null and forall(kinds, k -> coalesce(k = get(kinds, 0), false))")
    return rows.select("doc_id", F.concat("typed_path", F.lit("["), F.get("kinds", F.lit(0)), F.lit("]")).alias("path"), F.get("kinds", F.lit(0)).alias("kind"), "e")


def element_counts(found: DataFrame) -> DataFrame:
    """path, kind, whole, the value, cnt: a value once for each array, like ``stats.value_counts``; and a row with ``whole``, the number of arrays."""
    none = {"n": "cast(null as decimal(38,9))", "s": "cast(null as string)", "b": "cast(null as boolean)"}

    def column(name: str, kind: str) -> str:
        each = ", ".join(f"{'x' if k == name else v} as {k}" for k, v in none.items())
        return f"transform(array_distinct(transform(e, y -> try_variant_get(y, '$', '{kind}'))), x -> struct(false as whole, {each}))"

    shown = f"case kind when 'num' then {column('n', 'decimal(38,9)')} when 'str' then {column('s', 'string')} else {column('b', 'boolean')} end"
    whole = "array(struct(true as whole, " + ", ".join(f"{v} as {k}" for k, v in none.items()) + "))"
    values = found.select("path", "kind", F.explode(F.expr(f"concat({whole}, {shown})")).alias("v"))
    values = values.select("path", "kind", "v.whole", F.col("v.n").cast("double").alias("num_val"), F.col("v.n").alias("num_exact"), F.col("v.s").alias("str_val"), F.col("v.b").alias("bool_val"))
    return values.groupBy("path", "kind", "whole", *stats.VALUE).agg(F.count("*").alias("cnt"))


def enum_stats(nodes: DataFrame, config: EngineConfig) -> DataFrame:
    """STAT_COLUMNS of the enum arrays: count is the number of arrays; no min and max. Nodes of arrays are enough (``flatten`` with kinds)."""
    kind = config.stats_type
    counts = element_counts(candidates(nodes))
    if kind is StatType.HISTOGRAM:
        counts = written(counts)  # read by several aggregations
    element = ~F.col("whole")
    wanted = [F.sum(F.when(F.col("whole"), F.col("cnt"))).alias("count")]
    if kind is StatType.NDV_HYPERLOG:
        wanted.append(F.approx_count_distinct(F.when(element, F.coalesce(F.col("num_exact").cast("string"), "str_val", F.col("bool_val").cast("string"))), config.hll_error).alias("ndv"))
    elif kind is not StatType.BASIC:
        wanted.append(F.count_if(element).alias("ndv"))
    if kind is StatType.NDV_WITH_MODE:
        top = F.min(F.when(element, F.struct((-F.col("cnt")).alias("less"), "num_val", "str_val", "bool_val")))
        wanted.append(F.struct(*(top[c].alias(c) for c in ("num_val", "str_val", "bool_val")), (-top["less"]).alias("count")).alias("mode"))
    out = counts.groupBy("path", "kind").agg(*wanted).withColumn("null_count", F.lit(0).cast("bigint"))
    if kind is StatType.HISTOGRAM:
        out = out.join(histogram.frequency_histograms(counts.where(element), config.buckets), "path", "left")
    return stats.conformed(out)
