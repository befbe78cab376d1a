"""Daily progress of optimiser runs, from a folder of event files that grows.

A file stream with a checkpoint takes the files that are new and ends (availableNow). Each micro-batch is brought down to partial rows by day and run, which are written under the
day and the batch's number; then the days that the batch has touched are written anew from all their partial rows (dynamic partition overwrite). A batch that Spark repeats after a
failure writes the same partitions again. The checkpoint and the output belong together: neither is of use without the other. A file is taken once, by its path; input
grows by files that are added.

    python -m jobs.run_telemetry --events DIR/events.parquet --output DIR/out --checkpoint DIR/checkpoint
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshql.operators.checkpoints import settled
from meshql.streaming import telemetry

from . import common

log = logging.getLogger("run_telemetry")
PARTIAL = f"{telemetry.PARTIAL}, batch long"


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _pattern(path: str) -> str:
    """The path as a pattern that fits it alone: a file stream takes a single file only by a pattern, a folder either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def take(batch: DataFrame, number: int, output: str) -> int:
    """Bring one micro-batch into the output. Returns its number of events."""
    spark = batch.sparkSession
    own = settled(telemetry.day_partials(batch).withColumn("batch", F.lit(number).cast("long")))
    n = own.agg(F.sum("n")).first()[0] or 0
    if not n:
        return 0
    _write(own, f"{output}/partials", "day", "batch")
    days = F.broadcast(own.select(F.col("day").alias("touched")).distinct())  # a few bytes for each day
    partials = spark.read.schema(PARTIAL).parquet(f"{output}/partials")
    rows = settled(telemetry.day_rows(partials.join(days, F.col("day").eqNullSafe(F.col("touched")), "left_semi")))
    _write(rows, f"{output}/daily", "day")
    log.info("batch %d: read %d events, wrote %s/daily: %d rows in %d days", number, n, output, rows.count(), rows.select("day").distinct().count())
    return n


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict | None = None) -> int:
    """Take all event files at `events` that are new since the checkpoint, and wait for the end. Returns the number of events taken."""
    config = config or common.config_of(__file__)
    taken = []
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(events))
    query = stream.writeStream.foreachBatch(lambda batch, number: taken.append(take(batch, number, output))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %s: %d new events in %d batches", events, sum(taken), len(taken))
    return sum(taken)


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(telemetry.DAILY).parquet(f"{output}/daily")


#: The output by DuckDB.
SQL = """
SELECT user_id AS run, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, coalesce(sum(TRY_CAST(props::JSON ->> '$.k' AS BIGINT)), 0)::BIGINT AS k_total,
  min(value) AS best_value, arg_min(event_id, (value, event_id)) AS best_event, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event,
  arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
  CASE WHEN arg_min(value, (ts, event_id)) > 0 THEN round((arg_min(value, (ts, event_id)) - arg_max(value, (ts, event_id))) / arg_min(value, (ts, event_id)), 6) END AS rel_change, CAST(ts AS DATE) AS day
FROM events GROUP BY user_id, CAST(ts AS DATE)"""


def main(argv: list[str] | None = None) -> int:
    paths = {"events": "folder of Parquet event files", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"}
    return common.command("run_telemetry", paths, lambda spark, args: run(spark, args.events, args.output, args.checkpoint, common.config_of(__file__, args.config)), argv)


if __name__ == "__main__":
    sys.exit(main())
