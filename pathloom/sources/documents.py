"""Sources and sinks of document collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(texts: DataFrame) -> DataFrame:
    """doc_id by order of appearance within partitions: unique, not gapless."""
    return texts.select(F.monotonically_increasing_id().alias("doc_id"), F.try_parse_json("doc").alias("doc"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file (or files) that holds one JSON array of documents."""
    whole = spark.read.text(path, wholetext=True)
    found = whole.select(F.explode(F.expr("try_variant_get(try_parse_json(value), '$', 'array<variant>')")).alias("doc"))
    return found.select(F.monotonically_increasing_id().alias("doc_id"), "doc")


def json_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A document a line. ``most``: only the first lines of each file, as the source's own rule has it (100,000)."""
    lines = spark.read.text(path).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(F.trim("doc") != "").withColumn("n", F.monotonically_increasing_id())
    if most is not None:
        first = Window.partitionBy("file").orderBy("block", "n")
        lines = lines.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    return lines.select(F.col("n").alias("doc_id"), F.try_parse_json("doc").alias("doc"))


def json_lines_in_tar(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """collection, doc_id, doc: the first lines of each member ``*.json`` of tar archives; a collection's name is what follows the last ``_``.

    An archive is read as a stream by one task, member by member.
    """
    import io
    import re
    import tarfile
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["collection", "line", "doc"])

        for given in batches:
            for content in given.column(0).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".json"):
                            name, rows = re.sub(r"\.json$", "", member.name).rpartition("_")[2], []
                            for k, line in enumerate(archive.extractfile(member)):
                                if k >= most:
                                    break
                                rows.append((name, k, line.decode("utf-8", "replace")))
                                if len(rows) == 1000:
                                    yield batch(rows)
                                    rows = []
                            if rows:
                                yield batch(rows)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "collection string, line long, doc string")
    return found.where(F.trim("doc") != "").select("collection", F.col("line").alias("doc_id"), F.try_parse_json("doc").alias("doc"))


def csv_documents(spark: SparkSession, path: str, lists: tuple[str, ...] = (), keep: tuple[str, ...] = ("id", "license")) -> DataFrame:
    """Rows of a CSV file with a header (plain or .gz) as documents.

    Text that is a number becomes one, except in columns named in ``keep`` or with ``_id`` in their name; columns in ``lists`` hold lists of strings.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    parts = []
    for name in rows.columns:
        c = F.col(f"`{name}`")
        if name in lists:
            shown = F.to_json(string_list(c))
        else:
            text = _json_text(F.coalesce(c, F.lit("")))
            shown = text if name in keep or "_id" in name else F.coalesce(number_text(c), text)
        parts.append(F.concat(F.lit(_json_key(name)), shown))
    return _numbered(rows.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("doc")))


def _json_text(c: Column) -> Column:
    """A scalar as JSON text: that of a one-element array without its brackets."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _json_key(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False) + ":"


def number_text(c: Column) -> Column:
    """JSON text of the number a string holds: an integer if it is one, else a finite float; null otherwise."""
    text = F.trim(c)
    value = text.try_cast("double")
    is_whole = F.rlike(text, F.lit(r"^[+-]?[0-9]{1,38}$"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & ~F.rlike(text, F.lit("[dDfF]$"))
    return F.when(is_whole, text.try_cast("decimal(38,0)").cast("string")).when(finite, _json_text(value))


def string_list(c: Column) -> Column:
    """A list of strings from its JSON text, or from text with single quotes."""
    return F.coalesce(F.from_json(c, "array<string>"), F.from_json(F.regexp_replace(c, "'", '"'), "array<string>"), F.array().cast("array<string>"))


def json_in_csv(spark: SparkSession, path: str, before: int = 4) -> DataFrame:
    """Documents in the last column of a CSV file: everything behind the first ``before`` commas; the header line has no document."""
    rest = F.regexp_extract("value", rf"^(?:[^,]*,){{{before}}}(.*)$", 1)
    return _numbered(spark.read.text(path).select(rest.alias("doc")).where(F.startswith(F.ltrim("doc"), F.lit("{"))))


def first_documents(docs: DataFrame, most: int) -> DataFrame:
    return docs.orderBy("doc_id").limit(most)


def write_stats(stats: DataFrame, meta: DataFrame, folder: str) -> None:
    """Statistics and their meta row as JSON lines; values that are null are left out."""
    stats.write.mode("overwrite").json(f"{folder.rstrip('/')}/stats")
    meta.write.mode("overwrite").json(f"{folder.rstrip('/')}/meta")


def write_results(results: DataFrame, folder: str) -> None:
    results.write.mode("overwrite").parquet(folder)
