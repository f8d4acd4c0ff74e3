"""Command line.

    python -m pathloom.cli stats INPUT OUTPUT [TYPE]        statistics of a JSON array or of JSON lines
    python -m pathloom.cli experiment INPUT OUTPUT          results of the whole grid of settings, with their errors
    python -m pathloom.cli summary OUTPUT                   errors by operator of such results
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .config import EngineConfig, Prune, StatType, settings_grid
from .functions import metrics
from .plans import experiment
from .sources import documents

#: Short names of statistics types.
ALIASES = {"h": "HISTOGRAM", "hist": "HISTOGRAM", "histogram": "HISTOGRAM", "ndv": "BASIC_NDV", "hll": "NDV_HYPERLOG", "mode": "NDV_WITH_MODE", "basic": "BASIC"}


def stat_type(text: str) -> StatType:
    return StatType(ALIASES.get(text.lower(), text.upper()))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file ``*.json`` holds an array, ``*.tar`` lines of several collections, anything else lines."""
    if path.endswith(".json"):
        return documents.json_array(spark, path)
    return documents.json_lines_in_tar(spark, path).select("doc_id", "doc") if path.endswith(".tar") else documents.json_lines(spark, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("stats")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("type", nargs="?", type=stat_type, default=StatType.HISTOGRAM)
    s.add_argument("--sampling-rate", type=float, default=0.0)
    s.add_argument("--buckets", type=int, default=64)
    s.add_argument("--enum-arrays", action="store_true")
    s.add_argument("--prune", nargs="*", default=[], type=Prune)
    e = sub.add_parser("experiment")
    e.add_argument("input")
    e.add_argument("output")
    e.add_argument("--most", type=int, help="only the first configurations of the grid")
    m = sub.add_parser("summary")
    m.add_argument("output")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("pathloom").getOrCreate()
    if a.command == "stats":
        config = EngineConfig(a.type, a.sampling_rate, buckets=a.buckets, enum_arrays=a.enum_arrays, prune=frozenset(a.prune))
        documents.write_stats(*experiment.build(load(spark, a.input), config), a.output)
    elif a.command == "experiment":
        experiment.run_grid(load(spark, a.input), settings_grid()[: a.most], a.output)
    else:
        metrics.operator_summary(spark.read.parquet(a.output), "config_id", "op").orderBy("config_id", "op").show(1000, False)


if __name__ == "__main__":
    main()
