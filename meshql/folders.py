"""Work on whole folders of subjects, all hemispheres in one job: flattening, reports with shared limits, templates, frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FlattenConfig
from .operators import batch, mesh, metrics, report, snapshots, template
from .operators.checkpoints import settled
from .schema import KEY
from .sources import files


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """files.listing(), with no rows where there is no such folder yet."""
    try:
        return files.listing(spark, folder)
    except AnalysisException:
        return spark.createDataFrame([], "subject string, hemi string, kind string, path string")


@dataclass(frozen=True)
class Patches:
    """rows: the patches' rows; tri: faces in their ids; solid: their places on the base surfaces; failed: subject, hemi, error of those that can't be used."""

    rows: DataFrame
    tri: DataFrame
    solid: DataFrame
    failed: DataFrame


def load_patches(spark: SparkSession, there: DataFrame, patches: DataFrame, order: tuple[str, ...]) -> Patches | None:
    """The listed patches with their base surfaces, the first of `order` for each. A file that can't be read is an error of its hemisphere. None if no patch has a base.

    Paths are listed by the driver; contents are read by tasks.
    """
    base = settled(files.first_surface(there.join(patches.select(*KEY), KEY, "left_semi"), order))
    lost = patches.join(base.select(*KEY), KEY, "left_anti").select(*KEY, F.lit("no base surface").alias("error"))
    used = settled(patches.join(base.select(*KEY), KEY, "left_semi"))
    paths = [[r["path"] for r in df.collect()] for df in (used, base)]
    if not paths[0]:
        none = spark.createDataFrame([], "subject string, hemi string, pid long")
        return Patches(none, none, none, settled(lost))
    rows, places, tri = (settled(read(spark, own, tolerant=True)) for read, own in ((files.read_patches, paths[0]), (files.read_vertices, paths[1]), (files.read_faces, paths[1])))
    unread = settled(rows.unionByName(places, allowMissingColumns=True).where("failure is not null").groupBy(*KEY).agg(F.min("failure").alias("error")))
    rows, places, tri = (df.where("failure is null").drop("failure").join(unread, KEY, "left_anti") for df in (rows, places, tri))
    empty = used.select(*KEY).join(rows.select(*KEY).unionByName(unread.select(*KEY)), KEY, "left_anti").select(*KEY, F.lit("the patch is empty").alias("error"))
    solid = rows.select(*KEY, "pid", "vid").join(places, [*KEY, "vid"]).select(*KEY, F.col("pid").alias("vid"), "x", "y", "z")
    return Patches(settled(rows), settled(mesh.patch_faces(tri, rows)), settled(solid), settled(lost.unionByName(unread).unionByName(empty)))


def flatten_folder(spark: SparkSession, folder: str, output: str, config: FlattenConfig, overwrite: bool) -> DataFrame:
    """Flatten the cut patches of all subjects below a folder, each beside the others, and write output/subject/hemi.flat.patch.3d.

    A status row for each hemisphere: done, skipped (its flat patch is there, and overwrite isn't set) or error, with the reason. A file that can't be read, a hemisphere without
    a base surface or a mesh that fails is an error of its own hemisphere.
    """
    there = settled(files.listing(spark, folder))
    cut = there.where("kind = 'cut.patch.3d'")
    ready = (there if output == folder else _listed(spark, output)).where((F.col("kind") == "flat.patch.3d") & F.lit(not overwrite)).select(*KEY).distinct()
    ready = settled(cut.select(*KEY).join(ready, KEY, "left_semi"))
    todo = settled(cut.join(ready, KEY, "left_anti"))
    own = load_patches(spark, there, todo, files.BASE_SURFACES)
    out = ready.select(*KEY, F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(own.failed.withColumn("status", F.lit("error")))
    if own.rows.isEmpty():
        return settled(out)
    found = batch.flatten_batch(own.rows.select(*KEY, F.col("pid").alias("vid"), "x", "y", "z"), own.tri, config, base=own.solid)
    flat = found.uv.join(own.rows.select(*KEY, F.col("pid").alias("vid"), F.col("vid").alias("orig"), "is_border"), [*KEY, "vid"])
    # a row for each file written
    written = settled(files.write_patches(flat.select(*KEY, F.col("vid").alias("pid"), F.col("orig").alias("vid"), F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0.0).alias("z"), "is_border"), output, "flat.patch.3d"))
    return settled(found.status.join(written, KEY, "left").unionByName(out, allowMissingColumns=True))


def report_folder(spark: SparkSession, folder: str, method: str = "fast") -> DataFrame:
    """A row for each flat patch below a folder: the flatmap report, distortion with its histogram of 50 bins, the error that the optimiser's log names, limits for a grid.

    Distances are those of the method's rings. log_error is null without a log (hemi.*.log beside the patch). half, own_limit and shared_limit are null for subjects without both
    hemispheres. error tells why a hemisphere has no measures.
    """
    there = settled(files.listing(spark, folder))
    own = load_patches(spark, there, settled(there.where("kind = 'flat.patch.3d'")), files.REPORT_SURFACES)
    if own.rows.isEmpty():
        return own.failed
    uv = settled(own.rows.select(*KEY, F.col("pid").alias("vid"), F.col("x").alias("u"), F.col("y").alias("v")))
    ring = settled(report.method_rings(method, own.tri, own.solid))
    spread = settled(metrics.vertex_distortion(ring, uv))
    out = report.flatmap_report(own.solid, uv, own.tri, ring).join(report.median_distortion(spread), KEY).join(report.histogram_array(spread), KEY)
    logs = [r["path"] for r in there.where("kind like '%.log'").select("path").collect()]
    if logs:
        said = files.read_logs(spark, logs).select("subject", F.col("hemisphere").alias("hemi"), F.col("distance_error").alias("log_error")).where("log_error is not null").groupBy(*KEY).agg(F.max("log_error").alias("log_error"))
        out = out.join(said, KEY, "left")
    else:
        out = out.withColumn("log_error", F.lit(None).cast("double"))
    out = out.join(report.grid_limits(report.grid_layout(uv, meshes=uv.select(*KEY).distinct().count())), KEY, "left")
    return settled(out.unionByName(own.failed, allowMissingColumns=True))


def ground(spark: SparkSession, surf: str, hemi: str) -> DataFrame:
    """The surface of a folder that distances are taken on: fiducial, else halfway between smoothwm and pial, else either of them, else inflated."""
    there = {r["kind"]: r["path"] for r in _listed(spark, surf).where((F.col("hemi") == hemi) & F.col("kind").isin("fiducial", "smoothwm", "pial", "inflated")).collect()}
    if "fiducial" not in there and {"smoothwm", "pial"} <= set(there):
        return mesh.mean_surface(files.read_vertices(spark, there["smoothwm"]), files.read_vertices(spark, there["pial"]))
    for kind in ("fiducial", "smoothwm", "pial", "inflated"):
        if kind in there:
            return files.read_vertices(spark, there[kind])
    raise FileNotFoundError(f"no surface of {hemi} in {surf}")


def three_surfaces(spark: SparkSession, there: DataFrame, patch: str) -> DataFrame:
    """Vertices of each listed hemisphere on three surfaces side by side: vid, fx..fz (fiducial, or the first base there is), x..z (inflated), u, v (null off the patch)."""
    base = {r["path"] for r in files.first_surface(there).collect()}
    inflated = [r["path"] for r in there.where("kind = 'inflated'").collect()]
    flat = [r["path"] for r in there.where(F.col("kind") == patch).collect()]
    out = files.read_vertices(spark, inflated)
    out = out.join(files.read_vertices(spark, sorted(base)).select(*KEY, "vid", *[F.col(a).alias(f"f{a}") for a in "xyz"]), [*KEY, "vid"])
    return out.join(files.read_patches(spark, flat).select(*KEY, "vid", F.col("x").alias("u"), F.col("y").alias("v")), [*KEY, "vid"], "left")


def derive_template(spark: SparkSession, folder: str, patch: str, output: str) -> str:
    """The cuts of a subject's hemispheres, from patches cut by hand, as one JSON object with keys hemi_cut; written as text under `output`.

    Hemispheres need the patch, the inflated surface and a base surface, and are derived side by side.
    """
    there = settled(files.listing(spark, folder))
    kinds = there.groupBy(*KEY).agg(F.collect_set("kind").alias("kinds"))  # a few names for each hemisphere
    whole = F.array_contains("kinds", patch) & F.array_contains("kinds", "inflated") & F.arrays_overlap("kinds", F.array(*map(F.lit, files.BASE_SURFACES)))
    there = settled(there.join(kinds.where(whole).select(*KEY), KEY, "left_semi"))
    if there.isEmpty():
        raise FileNotFoundError(f"no hemisphere below {folder} has {patch}, inflated and a base surface")
    full = settled(three_surfaces(spark, there, patch))
    tri = settled(files.read_faces(spark, [r["path"] for r in there.where("kind = 'inflated'").collect()]))
    kept = full.where("u is not null").select(*KEY, "vid")
    cuts = template.derive(full.select(*KEY, "vid", "x", "y", "z"), tri, mesh.faces_within(tri, kept))
    files.template_json(cuts.withColumn("ord", F.col("vid"))).coalesce(1).write.mode("overwrite").text(output)  # one object
    return output


def write_frames(shots: DataFrame, frames: int, fps: float, output: str) -> str:
    """The frames of an animation as a table: frame_idx, step, phase label, box; held at the start, at turns of phase and at the end."""
    shots = shots if set(KEY) <= set(shots.columns) else shots.withColumns({c: F.lit("") for c in KEY})
    some = settled(snapshots.sampled(shots, frames))
    held = snapshots.with_holds(some, fps, 1.0, 0.5, 2.0).select(*KEY, "step", "frame_idx")
    held.join(snapshots.boxes(some), [*KEY, "step"]).join(snapshots.labels(some), [*KEY, "step"]).write.mode("overwrite").partitionBy(*KEY).parquet(output)
    return output
