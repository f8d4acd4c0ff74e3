"""Tables in the folder that driver and executors share: they cut lineage, survive lost executors, and have a known size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer bytes is often one row group of one file, and so one task.
SPREAD_BYTES = 16 << 20

#: Folders that this process has written, by application.
_folders: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent the context's own checkpoint folder is used. Without either, a local master gets a temporary folder; on a
    cluster, whose machines would not see it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="pathloom-"))
            held = context._jsc.sc().getCheckpointDir()
        root = held.get()
    folder = f"{root.rstrip('/')}/pathloom-{uuid.uuid4().hex}"
    _folders.setdefault(context.applicationId, []).append(folder)
    return folder


def spread(table: DataFrame, least: int = SPREAD_BYTES) -> DataFrame:
    """A table just read, dealt out to all cores if it has fewer than ``least`` bytes; larger ones have splits enough and stay as they are."""
    spark = table.sparkSession
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(spark.sparkContext.defaultParallelism) if size < least else table


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Removes all folders that this session has written so far; returns how many. Results that were not collected or written elsewhere are lost."""
    gone = _folders.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)
