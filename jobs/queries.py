"""The jobs as queries: each runs twice into a new folder of the shared one, and gives the whole output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from meshql.operators.checkpoints import shared_dir

from . import hemisphere_report, run_telemetry


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call; its files stay."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_hemisphere_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = folder(spark, "job1")
    for _ in range(2):
        hemisphere_report.run(spark, f"{sf_dir}/orders.parquet", output)
    return hemisphere_report.result(spark, output)


def job2_run_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = folder(spark, "job2")
    for _ in range(2):
        run_telemetry.run(spark, f"{sf_dir}/events.parquet", f"{output}/out", f"{output}/checkpoint")
    return run_telemetry.result(spark, f"{output}/out")


QUERIES = {"job1_hemisphere_report": job1_hemisphere_report, "job2_run_telemetry": job2_run_telemetry}
ORACLE_SQL = {"job1_hemisphere_report": hemisphere_report.SQL, "job2_run_telemetry": run_telemetry.SQL}
