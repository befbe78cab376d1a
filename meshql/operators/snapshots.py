"""Ordered optimisation snapshots: sampling, holds, boxes, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import KEY
from . import mesh
from .checkpoints import settled

REQUIRED = ("step", "uv")


def by_step() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("step")


def check(snapshots: DataFrame) -> DataFrame:
    if missing := [c for c in REQUIRED if c not in snapshots.columns]:
        raise ValueError(f"snapshots lack {', '.join(missing)}")
    return snapshots


def every_nth(snapshots: DataFrame, n: int) -> DataFrame:
    """The first and each n-th step, counted from 1."""
    return snapshots.where((F.col("step") % n == 0) | (F.col("step") == 1))


def sampled(snapshots: DataFrame, frames: int) -> DataFrame:
    """Evenly spaced snapshots by rank, first and last among them; halves round to even, places that coincide count once."""
    ranked = snapshots.withColumns({"_i": F.row_number().over(by_step()) - 1, "_n": F.count("*").over(Window.partitionBy(*KEY))})
    if frames == 1:
        return ranked.where("_i = 0").drop("_i", "_n")
    last = F.col("_n") - 1
    # of the frame numbers around rank * (frames - 1) / last one is rounded to the rank, if any is
    near = F.floor(F.col("_i") * (frames - 1) / last)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit = hit | ((F.bround((near + d) * last / F.lit(float(frames - 1))) == F.col("_i")) & (near + d).between(0, frames - 1))
    return ranked.where((F.col("_n") <= frames) | hit).drop("_i", "_n")


def with_holds(frames: DataFrame, fps: float, start: float, transition: float, end: float) -> DataFrame:
    """Frames with repeats: of the first, of each one before another phase, and of the last. frame_idx counts from 0.

    A mesh's frames are numbered by runs of steps; a run learns from a row for each run what follows it and how many frames come before.
    """
    cut = mesh.ranges(frames, "step")
    part, runs = Window.partitionBy(*KEY, "_part").orderBy("step"), Window.partitionBy(*KEY).orderBy("_part")
    ends = cut.groupBy(*KEY, "_part").agg(F.min(F.struct("step", "phase")).alias("_head"))
    ends = settled(ends.select(*KEY, "_part", F.lead("_head").over(runs).alias("_ahead"), (F.row_number().over(runs) == 1).alias("_opens")))
    rows = cut.join(ends, [*KEY, "_part"])
    first = F.col("_opens") & (F.row_number().over(part) == 1)
    nxt = F.coalesce(F.lead(F.struct("step", "phase")).over(part), F.col("_ahead"))
    turns = (F.col("phase") != "") & (F.col("_next.phase") != "") & (F.col("phase") != F.col("_next.phase"))
    times = 1 + F.when(F.col("_is_first"), max(0, int(start * fps))).otherwise(0) + F.when(F.coalesce(turns, F.lit(False)), max(0, int(transition * fps))).otherwise(0) + F.when(F.col("_next").isNull(), max(0, int(end * fps))).otherwise(0)
    timed = rows.withColumns({"_is_first": first, "_next": nxt}).withColumn("_times", times)
    sums = timed.groupBy(*KEY, "_part").agg(F.sum("_times").alias("_n"))
    before = settled(sums.select(*KEY, "_part", F.coalesce(F.sum("_n").over(runs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset")))
    own = F.coalesce(F.sum("_times").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = timed.withColumn("_at", own).join(before, [*KEY, "_part"]).withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return many.select(*frames.columns, (F.col("_offset") + F.col("_at") + F.col("_r")).cast("int").alias("frame_idx"))


def boxes(snapshots: DataFrame) -> DataFrame:
    """step, cx, cy, half: centre of each snapshot's bounding box and half of its longer side."""

    def side(f: str) -> tuple[Column, Column]:
        return F.array_min(F.transform("uv", lambda p: p[f])), F.array_max(F.transform("uv", lambda p: p[f]))

    (a, b), (c, d) = side("u"), side("v")
    return snapshots.select(*KEY, "step", ((a + b) / 2).alias("cx"), ((c + d) / 2).alias("cy"), (F.greatest(b - a, d - c) / 2).alias("half"))


def labels(snapshots: DataFrame) -> DataFrame:
    """step, label: the phase's name in words and the iteration."""
    return snapshots.select(*KEY, "step", F.concat_ws(" ", F.initcap(F.replace("phase", F.lit("_"), F.lit(" "))), F.col("iteration").cast("string")).alias("label"))


def energy_changes(snapshots: DataFrame) -> DataFrame:
    """step, total energy, its change relative to the step before in the same phase (null after an energy of 0), fewest flips so far."""
    total = F.col("j_d") + F.col("j_a")
    phase = Window.partitionBy(*KEY, "phase").orderBy("step")
    before = F.lag(total).over(phase)
    return snapshots.select(*KEY, "step", "phase", total.alias("energy"), F.when(before != 0, (before - total) / before).alias("rel_change"), F.min("n_flipped").over(by_step().rowsBetween(Window.unboundedPreceding, 0)).alias("best_flipped"))
