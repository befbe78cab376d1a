"""Snapshots and ring distances kept as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots as snap
from ..schema import KEY


def write_snapshots(snapshots: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Partitioned by phase; an empty set is an error."""
    if snap.check(snapshots).isEmpty():
        raise ValueError("no snapshots to write")
    snapshots.write.mode(mode).partitionBy("phase").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return snap.check(spark.read.parquet(path))


def mesh_hash(vertices: DataFrame, faces: DataFrame) -> str:
    """Content hash of meshes, in any order of rows."""
    parts = [df.agg(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()["h"] for df, cols in ((vertices, [*KEY, "vid", "x", "y", "z"]), (faces, [*KEY, "a", "b", "c"]))]
    return f"{(int(parts[0] or 0) * 31 + int(parts[1] or 0)) % (1 << 64):016x}"


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; computed and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.mode("ignore").parquet(path)
        return spark.read.parquet(path)
