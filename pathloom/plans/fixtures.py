"""Document collections made of the driver's tables: text of JSON documents, and their depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import parse_documents
from ..tables import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, a string with few values, a nested object."""
    rows = _table(spark, sf_dir, "events")
    shown = F.to_json(F.struct("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")))
    return rows.select(F.col("event_id").alias("doc_id"), shown.alias("doc"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key x of all types: int, float, string, bool, null, array, object, absent."""
    x = F.expr("""case event_id % 8 when 0 then concat(',"x":', event_id % 100) when 1 then concat(',"x":', cast(event_id % 50 as double) / 4) when 2 then concat(',"x":"', event_type, '"')
        when 3 then if(event_id % 3 = 0, ',"x":true', ',"x":false') when 4 then ',"x":null' when 5 then concat(',"x":[', user_id % 10, ',"', event_type, '"]')
        when 6 then concat(',"x":{"k":', event_id % 5, '}') else '' end""")
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit('{"event_id":'), "event_id", x, F.lit("}")).alias("doc"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional keys: quality and toxic are absent where there is no label."""
    docs, marks = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "lang", "source", "n_chars").join(marks, "doc_id", "left")
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", "n_chars", "quality", "toxic")).alias("doc"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects, an array of objects, and arrays of strings and of integers."""
    nation = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.struct("l_linenumber", "l_quantity", "l_returnflag")
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"), F.sort_array(F.collect_list("l_linenumber")).alias("lines")
    )
    rows = _table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    region = F.struct("r_name").alias("region")
    who = F.struct("c_custkey", "c_mktsegment", F.struct("n_name", region).alias("nation")).alias("customer")
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", who, "items", "flags", "lines")).alias("doc"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of objects and an array of strings for each conversation."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("size"))))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    doc = F.struct("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["size"].alias("size"))).alias("turns"), F.transform("t", lambda x: x["role"]).alias("roles"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.to_json(doc).alias("doc"))


#: name -> (maker, deepest nesting)
FIXTURES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], int]] = {"events": (events, 2), "mixed": (mixed, 2), "labels": (labels, 1), "orders": (orders, 4), "convs": (conversations, 3)}


def collection(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, int]:
    """(doc_id, doc VARIANT) and the depth."""
    maker, depth = FIXTURES[name]
    return parse_documents(maker(spark, sf_dir)), depth
