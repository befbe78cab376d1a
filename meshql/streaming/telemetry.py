"""Snapshots as a stream: files that appear in a folder are followed while an optimiser writes them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..schema import KEY, SCHEMAS


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming table of the snapshot files in a folder."""
    return spark.readStream.schema(SCHEMAS["snapshots"]).parquet(folder)


def progress(snapshots: DataFrame) -> DataFrame:
    """Per mesh and phase: steps, lowest energy, fewest flips. Works on a table and on a stream (complete mode)."""
    return snapshots.groupBy(*KEY, "phase").agg(F.count("*").alias("steps"), F.min(F.col("j_d") + F.col("j_a")).alias("lowest"), F.min("n_flipped").alias("fewest_flipped"), F.max("step").alias("last_step"))


def watch(snapshots: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps progress() of a stream in a memory table."""
    return progress(snapshots).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TRACE = "subject string, hemi string, step int, phase string, energy double, rel_change double, best_flipped int"
KEPT = "step int, best int, phases array<string>, energies array<double>"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Trace rows of a mesh's new snapshots. Kept between batches: the last step, the fewest flips, and each phase's last energy. Steps up to the last one are passed over."""
    last, best, phases, energies = state.get if state.exists else (-1, None, [], [])
    before = dict(zip(phases, energies, strict=True))
    for part in parts:
        out = []
        for r in part.drop_duplicates("step").sort_values("step").itertuples():
            if r.step <= last:
                continue
            was, best, last = before.get(r.phase), min(r.n_flipped, r.n_flipped if best is None else best), r.step
            out.append((*key, r.step, r.phase, r.energy, (was - r.energy) / was if was is not None and was != 0 else None, best))
            before[r.phase] = r.energy
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in TRACE.split(", ")])
            yield frame.astype({"step": "int32", "best_flipped": "int32", "rel_change": "float64"})
    state.update((int(last), None if best is None else int(best), list(before), [float(x) for x in before.values()]))


def traces(snapshots: DataFrame) -> DataFrame:
    """The rows of snapshots.energy_changes() from a stream of snapshots, as they come.

    A mesh's snapshots must come in the order of their steps, but for those of one micro-batch; a step that comes after a later one, or again, is passed over. The coordinates
    aren't read. State is a few numbers for each mesh and phase.
    """
    own = snapshots.select(*KEY, "step", "phase", (F.col("j_d") + F.col("j_a")).alias("energy"), "n_flipped")
    return own.groupBy(*KEY).applyInPandasWithState(_advance, TRACE, KEPT, "append", GroupStateTimeout.NoTimeout)


# --- events of runs, by day -----------------------------------------------------------------------------------------------

PARTIAL = "day date, run long, n long, n_errors long, k_total long, low struct<value:double,event:long>, head struct<ts:timestamp_ntz,event:long,value:double>, tail struct<ts:timestamp_ntz,event:long,value:double>"
DAILY = "run long, n long, n_errors long, k_total long, best_value double, best_event long, first_event long, last_event long, first_value double, last_value double, rel_change double, day date"


def day_partials(events: DataFrame) -> DataFrame:
    """PARTIAL rows of events (event_id, ts, user_id as the run, event_type, value, props): what can be merged with other events of the same run and day.

    An event without a time counts on no day (null). Values that are null or not a number count, but are never the lowest. k_total adds the field `k` of the JSON in props;
    where there is none it adds nothing. A hot run or day is brought down to one row a task before the shuffle.
    """
    ts, value = F.col("ts").cast("timestamp_ntz"), F.col("value").cast("double")
    at = F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.col("event_id").cast("long").alias("event"), value.alias("value")))
    low = F.when(value.isNotNull() & ~F.isnan(value), F.struct(value.alias("value"), F.col("event_id").cast("long").alias("event")))
    k = F.get_json_object("props", "$.k").try_cast("long")
    return events.groupBy(F.to_date(ts).alias("day"), F.col("user_id").cast("long").alias("run")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.coalesce(F.sum(k), F.lit(0)).alias("k_total"), F.min(low).alias("low"), F.min(at).alias("head"), F.max(at).alias("tail"),
    )


def day_rows(partials: DataFrame) -> DataFrame:
    """DAILY rows: per run and day the events, errors, lowest value and its first event id, first and last event by time, and the relative fall from the first value to the last."""
    total = partials.groupBy("day", "run").agg(*[F.sum(c).alias(c) for c in ("n", "n_errors", "k_total")], F.min("low").alias("low"), F.min("head").alias("head"), F.max("tail").alias("tail"))
    first, last = F.col("head.value"), F.col("tail.value")
    return total.select(
        "run", "n", "n_errors", "k_total", F.col("low.value").alias("best_value"), F.col("low.event").alias("best_event"), F.col("head.event").alias("first_event"), F.col("tail.event").alias("last_event"),
        first.alias("first_value"), last.alias("last_value"), F.when(first > 0, F.round((first - last) / first, 6)).alias("rel_change"), "day",
    )
