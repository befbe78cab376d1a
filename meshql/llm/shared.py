"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import map_file, new_folder, remove, settled as cut, shared_dir, write_file

__all__ = ["crc", "cut", "map_file", "new_folder", "partitions_for", "remove", "shared_dir", "sharded", "table", "write_file"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(column: Column) -> Column:
    """Unsigned crc32 of a value's text; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def partitions_for(df: DataFrame) -> int:
    """Shards for aggregating what a scan of df yields: a power of two near its number of input splits, 16 at least."""
    return 1 << max(4, (df.rdd.getNumPartitions() - 1).bit_length())


def sharded(df: DataFrame, column: str, shards: int) -> DataFrame:
    """df with every shard (0 to shards - 1) in a partition of its own, so that no task takes several of them whatever AQE would join."""
    return df.repartitionById(shards, F.col(column).cast("int"))
