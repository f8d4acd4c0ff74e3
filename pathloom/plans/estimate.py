"""Cardinality estimates for predicates, in bulk.

``predicates`` has pred_id, op, path, kind, num, str, bool, lo, hi and els, an array of (kind, num, str, bool) for array operands. All estimates of a
batch are one CASE expression over predicates joined with the statistics, and for array operators with the enum-array rows too.

Operands are doubles: the result is ceil(estimate / (1 - sampling_rate)) in binary arithmetic. An estimate is null where the statistics say nothing,
such as an inequality on an object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, Prune, StatType
from ..operators import prune
from ..operators.flatten import last_components

PREDICATE = "pred_id bigint, op string, path string, kind string, num double, str string, bool boolean, lo double, hi double, els array<struct<kind:string,num:double,str:string,bool:boolean>>"
OPERATORS = ("exists", "not_null", "is_null", "gt", "lt", "range", "eq", "memberof", "contains", "overlaps")

#: Shares of the highest skipped count that stand for a path without statistics.
MISSING = {"exists": 1.0, "not_null": 0.9, "is_null": 0.1, "gt": 0.3, "lt": 0.3, "range": 0.3, "eq": 0.1, "memberof": 0.1, "contains": 0.1, "overlaps": 0.3}
EQ_SHARE, EQ_BOOL_SHARE, MEMBER_SHARE = 0.1, 0.5, 0.1

V = "cast(count - null_count as double)"
R = "(max_num - min_num)"
LOWER = "if(i = 0, min_num, get(buckets, i - 1).num)"


def _over_buckets(term: str) -> str:
    """Sum of ``term`` over the buckets; b is the bucket, ``LOWER`` its lower bound."""
    return f"aggregate(transform(sequence(0, size(buckets) - 1), i -> {term.replace('b.', 'buckets[i].')}), 0D, (a, x) -> a + x)"


def _histogram(equi: str, singleton: str | None) -> str:
    return f"case hist_type when 'EQUI_HEIGHT' then {equi}" + (f" when 'SINGLETON' then {singleton}" if singleton else "") + " end"


def _gt(kind: StatType) -> str:
    linear = f"try_divide(least(max_num - num, {R}), {R}) * {V}"
    if kind is StatType.HISTOGRAM:
        equi = _over_buckets(f"case when {LOWER} > num then cast(b.count as double) when b.num > num then if(b.ndv = 1, cast(b.count as double), b.count * ((b.num - num) / (b.num - {LOWER}))) else 0D end")
        body = _histogram(equi, _over_buckets("if(b.num > num, cast(b.count as double), 0D)"))
    elif kind is StatType.NDV_WITH_MODE:
        shift = f"coalesce(if(mode.num_val > num, mode.count - {V} / ndv, {V} / ndv - mode.count), 0D)"
        body = f"greatest({linear} + {shift}, 1D)"
    else:
        body = linear
    return f"case when max_num is null then null when num >= max_num or max_num = min_num then 0D else {body} end"


def _lt(kind: StatType) -> str:
    linear = f"try_divide(least(num - min_num, {R}), {R}) * {V}"
    if kind is StatType.HISTOGRAM:
        equi = _over_buckets(f"case when b.num < num then cast(b.count as double) when (i = 0 or get(buckets, i - 1).num < num) and b.ndv > 1 then b.count * ((num - {LOWER}) / (b.num - {LOWER})) else 0D end")
        body = _histogram(equi, _over_buckets("if(b.num < num, cast(b.count as double), 0D)"))
    elif kind is StatType.NDV_WITH_MODE:
        shift = f"coalesce(if(mode.num_val < num, mode.count - {V} / ndv, {V} / ndv - mode.count), 0D)"
        body = f"greatest({linear} + {shift}, 1D)"
    else:
        body = linear
    return f"case when max_num is null then null when num <= min_num or max_num = min_num then 0D else {body} end"


def _range(kind: StatType) -> str:
    if kind is StatType.NDV_WITH_MODE:
        return "cast(null as double)"
    if kind is StatType.HISTOGRAM:
        inside = "(b.num >= lo and b.num <= hi)"
        equi = _over_buckets(f"case when b.num = {LOWER} then if({inside}, cast(b.count as double), 0D) else greatest(least(b.num, hi) - greatest({LOWER}, lo), 0D) / (b.num - {LOWER}) * b.count end")
        return _histogram(equi, None)
    over = "(least(max_num, hi) - greatest(min_num, lo))"
    return f"case when max_num is null then null when {over} < 0 then 0D when {R} = 0 then {V} else {over} / {R} * {V} end"


def _eq(kind: StatType) -> str:
    outside = "case op_kind when 'num' then num > max_num or num < min_num when 'str' then str > max_str or str < min_str else bool > max_bool or bool < min_bool end"
    if kind is StatType.BASIC:
        body = f"{V} * if(op_kind = 'bool', {EQ_BOOL_SHARE}D, {EQ_SHARE}D)"
    elif kind is StatType.NDV_WITH_MODE:
        equal = "case op_kind when 'num' then mode.num_val = num when 'str' then mode.str_val = str else mode.bool_val = bool end"
        body = f"case when mode is null then {V} / ndv when {equal} then cast(mode.count as double) when ndv = 1 then 0D else ({V} - mode.count) / (ndv - 1) end"
    elif kind is StatType.HISTOGRAM:
        hit = "filter(buckets, b -> case op_kind when 'num' then b.num = num when 'str' then b.str = str else b.bool = bool end)"
        exact = f"cast(get({hit}, 0).count as double)"
        equi = "get(transform(filter(buckets, b -> b.num >= num), b -> b.count / b.ndv), 0)"
        rest = "element_at(buckets, -1).count / element_at(buckets, -1).ndv"
        body = f"case coalesce(hist_type, '') when '' then {V} / ndv when 'SINGLETON' then coalesce({exact}, 0D) when 'EQUI_HEIGHT' then coalesce({equi}, 0D) else coalesce({exact}, {rest}) end"
    else:
        body = f"try_divide({V}, ndv)"
    return f"case when {outside} then 0D when ({outside}) is null then null else {body} end"


def _member(kind: StatType) -> str:
    """Of one element x over the array path's row and the enum row e (a struct, null if there is none)."""
    share = f"count * {MEMBER_SHARE}D"
    if kind is StatType.BASIC:
        return f"coalesce(e.count, count) * {MEMBER_SHARE}D"
    if kind is StatType.NDV_WITH_MODE:
        equal = "case x.kind when 'num' then e.mode.num_val = x.num when 'str' then e.mode.str_val = x.str else e.mode.bool_val = x.bool end"
        return f"case when e is null then {share} when e.mode is null then e.count / e.ndv when {equal} then cast(e.mode.count as double) when e.ndv = 1 then 0D else (e.count - e.mode.count) / (e.ndv - 1) end"
    if kind is StatType.HISTOGRAM:
        hit = "get(filter(e.buckets, b -> case x.kind when 'num' then b.num = x.num when 'str' then b.str = x.str else b.bool = x.bool end), 0).count"
        return f"case when e is null then {share} else coalesce({hit}, if(e.hist_type = 'SINGLETON_PLUS', element_at(e.buckets, -1).count, null), {share}) end"
    return f"case when e is null then {share} else try_divide(e.count, e.ndv) end"


def estimates(predicates: DataFrame, stats: DataFrame, meta: DataFrame, config: EngineConfig) -> DataFrame:
    """pred_id, op, path, estimate for every predicate; ``meta`` has highest_count_skipped in one row."""
    kind = config.stats_type
    preds = predicates.withColumn("__stored", F.col("path"))
    if Prune.MAX_PREFIX_LENGTH in config.prune:
        preds = preds.withColumn("__stored", last_components(F.col("path"), config.max_prefix, config))
    elif Prune.UNIQUE_SUFFIX in config.prune:
        found = prune.lookup_paths(predicates, stats, config)
        preds = preds.drop("__stored").join(found.withColumnRenamed("stored", "__stored"), "path", "left")
    # One row of the statistics for each path; rows for enum arrays have paths of their own.
    own = stats.withColumnsRenamed({"path": "__path", "kind": "stat_kind"})
    rows = preds.withColumnRenamed("kind", "op_kind").join(own, F.col("__stored") == F.col("__path"), "left").crossJoin(F.broadcast(meta.select(F.col("highest_count_skipped").alias("hcs"))))
    scalar = f"""case op
        when 'exists' then cast(count as double) when 'not_null' then {V} when 'is_null' then cast(null_count as double)
        when 'gt' then {_gt(kind)} when 'lt' then {_lt(kind)} when 'range' then {_range(kind)} when 'eq' then {_eq(kind)} end"""
    missing = "case " + " ".join(f"when op = '{o}' then hcs * {m}D" for o, m in MISSING.items()) + " end"
    missing = f"case when op = 'eq' and op_kind = 'bool' then hcs * {EQ_BOOL_SHARE}D when op = 'contains' and size(els) = 0 then cast(hcs as double) else {missing} end"
    simple = rows.where("op not in ('memberof', 'contains', 'overlaps')").select("pred_id", "op", "path", F.expr(f"case when __path is null then {missing} else {scalar} end").alias("e"))

    arrays = rows.where("op in ('memberof', 'contains', 'overlaps')")
    arrays = arrays.select("pred_id", "op", "path", "__path", "__stored", "count", "null_count", "hcs", "op_kind", "els", F.explode_outer(F.expr("array_distinct(els)")).alias("x"))
    enum = stats.select(F.col("path").alias("__enum"), F.struct("count", "ndv", "mode", "hist_type", "buckets").alias("e"))
    arrays = arrays.join(enum, F.concat("__stored", F.lit("["), F.col("x.kind"), F.lit("]")) == F.col("__enum"), "left")
    each = arrays.withColumn("m", F.when(F.col("x").isNotNull(), F.expr(_member(kind))))
    whole = each.groupBy("pred_id", "op", "path").agg(
        F.min("m").alias("low"), F.max("m").alias("high"), F.count("x").alias("n"), F.max(F.expr(V)).alias("v"), F.max(F.expr(missing)).alias("missing"), F.max("__path").alias("found")
    )
    array_value = F.expr("""case when op = 'overlaps' and n = 0 then 0D
        when found is null then missing when op = 'contains' and n = 0 then v when op = 'overlaps' then high
        when op = 'contains' and n > 1 then low / n else low end""")
    out = simple.unionByName(whole.select("pred_id", "op", "path", array_value.alias("e")))
    return out.select("pred_id", "op", "path", F.ceil(F.col("e") / (F.lit(1.0) - F.lit(config.sampling_rate))).alias("estimate"))


def predicate_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Predicates from (op, path, operand): None, a number, string or bool, a (low, high) tuple for range, or a list for contains and overlaps."""

    def element(v):
        kind = "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str"
        return kind, float(v) if kind == "num" else None, v if kind == "str" else None, v if kind == "bool" else None

    out = []
    for k, (op, path, v) in enumerate(rows):
        scalar = element(v) if v is not None and not isinstance(v, (tuple, list)) else (None,) * 4
        low, high = v if op == "range" else (None, None)
        els = [element(x) for x in v] if isinstance(v, list) else [element(v)] if op == "memberof" else None
        out.append((k, op, path, *scalar, None if low is None else float(low), None if high is None else float(high), els))
    return spark.createDataFrame(out, PREDICATE)
