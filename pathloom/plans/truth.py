"""Exact predicate counts, in bulk: the truth that estimates are compared with.

Predicates here have a ``json_path`` (components joined by /) besides their operands. ``collected`` counts the values and arrays of each path in one
pass over the nodes, as a written table; operands and truths follow from it. Equalities are an equi-join with the counts; inequalities and ranges
look up running sums; array operators test each array once against the operands of its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import VALUE
from ..tables import written

#: The operators of each operand's kind. An empty array contains nothing but the empty array, and overlaps nothing.
SCALAR = ("exists", "not_null", "is_null")


ELEMENTS = "array<struct<kind:string,num:double,str:string,bool:boolean>>"
#: An element of an array as text with its kind; empty for null and for containers.
_TAG = """concat_ws(':', x.kind, case x.kind when 'num' then cast(x.num as string) when 'str' then x.str else cast(x.bool as string) end)"""
_HELD = """transform(transform(try_variant_get(arr, '$', 'array<variant>'), v -> named_struct('v', v, 't', schema_of_variant(v))), x -> case when x.t = 'STRING' then concat('str:', try_variant_get(x.v, '$', 'string'))
    when x.t = 'BOOLEAN' then concat('bool:', cast(try_variant_get(x.v, '$', 'boolean') as string)) when x.t rlike '^(BIGINT|DOUBLE|DECIMAL)' then concat('num:', cast(try_variant_get(x.v, '$', 'double') as string)) else '' end)"""


def collected(nodes: DataFrame) -> DataFrame:
    """json_path, typed_path, base_path, kind, the value in its column or ``own`` (an array's elements as texts), cnt: a written table. What is
    given already collected is returned."""
    if "cnt" in nodes.columns:
        return nodes
    rows = nodes.withColumn("num_val", F.when(F.col("num_val") == 0, 0.0).otherwise(F.col("num_val")))  # -0.0 and 0.0 are one number
    keys = [F.array_join("json_path", "/").alias("json_path"), "typed_path", "base_path", "kind", *VALUE, F.expr(_HELD).alias("own")]
    return written(rows.groupBy(*keys).agg(F.count("*").alias("cnt")))


def scalar_values(nodes: DataFrame) -> DataFrame:
    """json_path, kind, num, str, bool, cnt."""
    rows = collected(nodes).where(F.col("kind").isin("num", "str", "bool"))
    return rows.groupBy("json_path", "kind", F.col("num_val").alias("num"), F.col("str_val").alias("str"), F.col("bool_val").alias("bool")).agg(F.sum("cnt").alias("cnt"))


def operands(nodes: DataFrame, per_path: int = 25) -> DataFrame:
    """Up to ``per_path`` distinct primitive values of each path, chosen by the hash of their text: json_path, typed_path, base_path, kind, num, str, bool."""
    rows = collected(nodes).where(F.col("kind").isin("num", "str", "bool"))
    distinct = rows.select("json_path", "typed_path", "base_path", "kind", F.col("num_val").alias("num"), F.col("str_val").alias("str"), F.col("bool_val").alias("bool")).distinct()
    text = F.coalesce(F.col("num").cast("string"), "str", F.col("bool").cast("string"))
    return _first_by_hash(distinct, text, per_path, "kind", text)


def _first_by_hash(rows: DataFrame, text: Column, most: int, *ties: str | Column) -> DataFrame:
    """The ``most`` rows of each path whose text has the smallest hash. Few are left of each of 32 shares before a path's rows meet."""
    rows = rows.withColumn("__h", F.md5(text.cast("binary")))
    share = Window.partitionBy("json_path", F.substring("__h", 3, 1), F.substring("__h", 4, 1) < "8").orderBy("__h", *ties)
    whole = Window.partitionBy("json_path").orderBy("__h", *ties)
    rows = rows.withColumn("__r", F.row_number().over(share)).where(F.col("__r") <= most)
    return rows.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= most).drop("__r", "__h")


def array_operands(nodes: DataFrame, per_path: int = 25) -> DataFrame:
    """json_path, typed_path, element, subset for up to ``per_path`` distinct arrays of each path, chosen like ``operands``.

    The element is the primitive one with the smallest hash (null if there is none); the subset has those whose hash begins with 0 to 7, or the element.
    """
    text = F.array_join("own", ",")
    rows = _first_by_hash(collected(nodes).where("kind = 'arr'").select("json_path", "typed_path", "own").distinct(), text, per_path, text)
    hashed = "array_sort(transform(filter(array_distinct(own), x -> x != ''), x -> named_struct('h', md5(cast(x as binary)), 'x', x)))"
    rows = rows.withColumn("__e", F.expr(hashed)).withColumn("__s", F.expr("filter(__e, x -> x.h < '8')"))
    parsed = "transform({0}, y -> named_struct('kind', substring_index(y.x, ':', 1), 'v', substring(y.x, instr(y.x, ':') + 1)))"
    typed = "transform({0}, z -> named_struct('kind', z.kind, 'num', if(z.kind = 'num', cast(z.v as double), null), 'str', if(z.kind = 'str', z.v, null), 'bool', if(z.kind = 'bool', cast(z.v as boolean), null)))"
    shown = lambda x: F.expr(typed.format(parsed.format(x))).cast(ELEMENTS)
    return rows.select("json_path", "typed_path", shown("slice(__e, 1, 1)").alias("element"), shown("if(size(__s) > 0, __s, slice(__e, 1, 1))").alias("subset"))


def predicates(nodes: DataFrame, per_path: int = 25) -> DataFrame:
    """Predicates over all paths of the nodes: exists, null tests; eq and (for numbers) lt and gt with the chosen operands; and of arrays memberof with
    the chosen element, contains and overlaps with the chosen subset.

    pred_id, op, path (typed or base key path), json_path, kind, num, str, bool, lo, hi, els.
    """
    nodes = collected(nodes)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("num", "double"), ("str", "string"), ("bool", "boolean"), ("els", ELEMENTS))}
    base = nodes.select(F.col("base_path").alias("path"), "json_path").distinct()
    plain = base.select(F.explode(F.array(*map(F.lit, SCALAR))).alias("op"), "path", "json_path", *none.values())
    values = operands(nodes, per_path)
    ops = F.when(F.col("kind") == "num", F.array(F.lit("eq"), F.lit("lt"), F.lit("gt"))).otherwise(F.array(F.lit("eq")))
    compare = values.select(F.explode(ops).alias("op"), F.col("typed_path").alias("path"), "json_path", "kind", "num", "str", "bool", none["els"])
    asked = F.array(*(F.struct(F.lit(op).alias("op"), F.col(c).alias("els")) for op, c in (("memberof", "element"), ("contains", "subset"), ("overlaps", "subset"))))
    arrays = array_operands(nodes, per_path).select(F.explode(asked).alias("q"), F.col("typed_path").alias("path"), "json_path")
    arrays = arrays.where("q.op != 'memberof' or size(q.els) > 0").select("q.op", "path", "json_path", *(none[c] for c in ("kind", "num", "str", "bool")), "q.els").distinct()
    rows = plain.unionByName(compare).unionByName(arrays).withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    return rows.withColumn("pred_id", F.xxhash64("op", "path", "json_path", "kind", "num", "str", "bool", "els"))


def truths(preds: DataFrame, nodes: DataFrame) -> DataFrame:
    """pred_id, truth for every predicate."""
    nodes = collected(nodes)
    counts = nodes.groupBy("json_path").agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("kind") == "null", F.col("cnt")).otherwise(0)).alias("nulls"))
    plain = preds.where(F.col("op").isin(*SCALAR)).join(counts, "json_path", "left")
    plain = plain.select("pred_id", F.expr("case op when 'exists' then n when 'is_null' then nulls else n - nulls end").alias("truth"))

    values = scalar_values(nodes)
    eq = preds.where("op = 'eq'").select("pred_id", "json_path", "kind", "num", "str", "bool")
    same = F.expr("p.json_path = v.json_path and p.kind = v.kind and p.num <=> v.num and p.str <=> v.str and p.bool <=> v.bool")
    eq = eq.alias("p").join(values.alias("v"), same, "left").groupBy("pred_id").agg(F.sum("cnt").alias("truth"))
    out = plain.unionByName(eq).unionByName(_ordered(preds, values)).unionByName(_arrays(preds, nodes))
    return preds.select("pred_id").join(out, "pred_id", "left").select("pred_id", F.coalesce("truth", F.lit(0)).cast("bigint").alias("truth"))


def _ordered(preds: DataFrame, values: DataFrame) -> DataFrame:
    """lt, gt and range from running sums: operands and values are sorted together, path by path."""
    numbers = values.where("kind = 'num'").groupBy("json_path", "num").agg(F.sum("cnt").alias("cnt"))
    side = F.lit(None).cast("bigint")
    data = numbers.select("json_path", F.col("num").alias("x"), F.lit(1).alias("place"), "cnt", side.alias("pred_id"), side.alias("sign"))
    # place 0 sees what is below the operand, place 2 also what equals it
    asked = preds.where(F.col("op").isin("lt", "gt", "range")).select("pred_id", "json_path", F.explode(F.expr("""case op
        when 'lt' then array(struct(num as x, 0 as place, 1 as sign)) when 'gt' then array(struct(num as x, 2 as place, -1 as sign))
        else array(struct(hi as x, 2 as place, 1 as sign), struct(lo as x, 0 as place, -1 as sign)) end""")).alias("q"), "op")
    asked = asked.select("json_path", "q.x", "q.place", F.lit(0).cast("bigint").alias("cnt"), "pred_id", F.col("q.sign").cast("bigint").alias("sign"))
    running = F.sum("cnt").over(Window.partitionBy("json_path").orderBy("x", "place").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    below = data.unionByName(asked).withColumn("below", running).where("pred_id is not null").groupBy("pred_id").agg(F.sum(F.col("below") * F.col("sign")).alias("s"))
    total = numbers.groupBy("json_path").agg(F.sum("cnt").alias("total"))
    shown = preds.where(F.col("op").isin("lt", "gt", "range")).select("pred_id", "json_path", "op").join(total, "json_path", "left").join(below, "pred_id", "left")
    return shown.select("pred_id", F.when(F.col("op") == "gt", F.col("total") + F.col("s")).otherwise(F.col("s")).alias("truth"))


def _arrays(preds: DataFrame, nodes: DataFrame) -> DataFrame:
    """contains, overlaps and memberof. Elements compare with their type; an array is tested as a set of (kind, value) texts."""
    ops = preds.where(F.col("op").isin("contains", "overlaps", "memberof")).select("pred_id", "op", "json_path", F.expr(f"transform(els, x -> {_TAG})").alias("wanted"))
    held = nodes.where("kind = 'arr'").groupBy("json_path", "own").agg(F.sum("cnt").alias("cnt"))
    met = F.expr("case op when 'overlaps' then arrays_overlap(own, wanted) else size(array_except(wanted, own)) = 0 end")
    return ops.join(held, "json_path").where(met).groupBy("pred_id").agg(F.sum("cnt").alias("truth"))
