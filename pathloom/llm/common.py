"""What the operators of this subpackage share: shared folders, tables that cut lineage, Arrow batches of texts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_folder, spread, written

__all__ = ["map_rows", "python_stage", "shared_folder", "ship", "table", "text_bytes", "without", "words_of", "written"]

#: Most rows that Spark hands to a Python worker at once. Texts can be long, so this is well under Spark's default.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def without(docs: DataFrame, ids: DataFrame, most: int = 200_000) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``.

    ``ids`` is written and counted: up to ``most`` rows it is broadcast, beyond that the join is a shuffle.
    """
    ids = written(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_anti").select(docs.columns)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, whatever their path: Spark's own file server hands out a small archive of it, once a session."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId not in _shipped and package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="pathloom-code-")) / "pathloom-code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def python_stage(spark: SparkSession) -> None:
    """Before a stage in Python: ship the code, and bound the Arrow batches by rows, as the rows hold whole texts."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_rows(df: DataFrame, schema: str, function: Callable[[Iterator[tuple]], Iterable[tuple]], chunk: int = 4096, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``mapInArrow`` over tuples: ``function`` gets the rows of a partition one by one and yields output tuples.

    Output leaves in batches of at most ``chunk`` rows or about ``chunk_bytes`` of text, so memory stays bounded.
    """
    python_stage(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

        out, held = [], 0
        for row in function(rows()):
            out.append(row)
            held += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if len(out) >= chunk or held >= chunk_bytes:
                yield _batch(out, target)
                out, held = [], 0
        if out:
            yield _batch(out, target)

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in ASCII lower case: bytes.split and bytes.lower know just these characters."""
    return text.lower().split()
