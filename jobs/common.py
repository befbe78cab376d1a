"""What the jobs' command lines share: the config file, the log, and tables that may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def config_of(module_file: str, path: str | None = None) -> dict:
    """The options of the config file beside a job; those of another file, if one is named, win."""
    own = json.loads(Path(module_file).with_suffix(".json").read_text(encoding="utf-8"))
    given = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    if odd := set(given) - set(own):
        raise ValueError(f"unknown options: {', '.join(sorted(odd))}")
    return own | given


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at a path, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return None


def command(name: str, paths: dict[str, str], work: Callable[[SparkSession, argparse.Namespace], object], argv: list[str] | None = None) -> int:
    """Parse --PATH options and --config, start a session, do the work and stop the session."""
    parser = argparse.ArgumentParser(prog=name)
    for option, text in paths.items():
        parser.add_argument(f"--{option}", required=True, help=text)
    parser.add_argument("--config", help="JSON file with options that differ from the job's own")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, args)
    finally:
        spark.stop()
    return 0
