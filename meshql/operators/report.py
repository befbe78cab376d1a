"""The tables behind plots: flatmap report, projected views, area distortion, grids of flatmaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import norm, signed_area, softplus, vec
from ..schema import KEY
from . import energy, mesh, metrics, rings
from .checkpoints import settled

#: Elevation and azimuth of the views, by hemisphere.
VIEWS = {("lh", "medial"): (0, 0), ("rh", "medial"): (0, 180), ("lh", "ventral"): (-90, 180), ("rh", "ventral"): (-90, 180), ("lh", "frontal"): (0, -90), ("rh", "frontal"): (0, -90)}
#: ... direction of the light, ambient and diffuse share.
LIGHT, AMBIENT, DIFFUSE = (0.3, 0.5, 0.8), 0.4, 0.6


def view_angles(hemi: str, view: str) -> tuple[int, int]:
    if (hemi, view) not in VIEWS:
        raise ValueError(f"no view {view!r} of {hemi!r}")
    return VIEWS[hemi, view]


def flatmap_report(vertices: DataFrame, uv: DataFrame, faces: DataFrame, kring: DataFrame | None = None) -> DataFrame:
    """One row per mesh: faces, flips, areas, distance error over the given pairs (default: 1-ring), softplus energy."""
    return points_report(vertices.join(uv.select(*KEY, "vid", "u", "v"), [*KEY, "vid"]), faces, kring)


def points_report(points: DataFrame, faces: DataFrame, kring: DataFrame | None = None) -> DataFrame:
    """flatmap_report() of points with x, y, z, u, v: the corners are joined once for both areas, the ends of edges once for both lengths."""
    k = energy.STEEPNESS
    a = F.col("area")
    clipped = F.least(F.greatest(a, F.lit(-400 / k)), F.lit(400 / k))
    sums = metrics.both_areas(faces, points).groupBy(*KEY).agg(
        F.count("*").alias("n_faces"), F.count_if(a < 0).alias("n_flipped"), F.sum(F.when(a > 0, a).otherwise(0.0)).alias("area_2d_pos"),
        F.sum(F.when(a < 0, -a).otherwise(0.0)).alias("area_2d_neg"), F.sum(softplus(k * clipped) / k - clipped).alias("j_a"), F.sum("area0").alias("area_3d"),
    )
    error = metrics.distance_error(metrics.k1_in_plane(faces, points) if kring is None else kring, points)
    return sums.join(error, KEY).withColumn("flipped_pct", 100 * F.col("n_flipped") / F.col("n_faces"))


def face_sums(points: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per mesh, from corners that are joined once for all of it: area in space, area_2d_pos, area_2d_neg, n_flipped, and half, half the longer side of the box around the vertices in use."""
    a = F.col("area2")
    ends = [f(*[F.col(f"{c}{i}") for i in range(3)]).alias(f"{n}_{c}") for c in "uv" for n, f in (("low", F.least), ("high", F.greatest))]
    c = mesh.corners(faces, points, ["x", "y", "z", "u", "v"])
    c = c.select(*KEY, (0.5 * norm(metrics.face_normal())).alias("area0"), signed_area(vec("0", "uv"), vec("1", "uv"), vec("2", "uv")).alias("area2"), *ends)
    side = [F.max(f"high_{c}") - F.min(f"low_{c}") for c in "uv"]
    return c.groupBy(*KEY).agg(
        F.sum("area0").alias("area"), F.sum(F.when(a > 0, a).otherwise(0.0)).alias("area_2d_pos"), F.sum(F.when(a < 0, -a).otherwise(0.0)).alias("area_2d_neg"),
        F.count_if(a < 0).alias("n_flipped"), (F.greatest(*side) / 2).alias("half"),
    )


def method_rings(method: str, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Ring distances for a report: `fast` 2 rings whole, `sampled` 7 rings of 12 samples."""
    if method not in ("fast", "sampled"):
        raise ValueError(f"no method {method!r}")
    adj = mesh.mesh_graph(faces, vertices)
    if method == "fast":
        return rings.geodesics(adj, 2)
    return rings.sampled_rings(adj, vertices, metrics.vertex_normals(faces, vertices), 7, 12)


def rotation(elevation: float, azimuth: float) -> list[list[float]]:
    """Matrix that turns the azimuth about Z, puts Y to the right, Z up and X to the viewer, then tilts by the elevation."""
    e, a = math.radians(elevation), math.radians(azimuth)
    right = [math.sin(a), math.cos(a), 0.0]
    up, toward = [0.0, 0.0, 1.0], [math.cos(a), -math.sin(a), 0.0]
    return [right, [math.cos(e) * u - math.sin(e) * t for u, t in zip(up, toward, strict=True)], [math.sin(e) * u + math.cos(e) * t for u, t in zip(up, toward, strict=True)]]


def view_faces(vertices: DataFrame, faces: DataFrame, curvature: DataFrame, patch_vertices: DataFrame, hemi: str, view: str, *, turned_over: bool = False) -> DataFrame:
    """Faces that a view shows: fid, is_cut, shade, depth, depth_rank (far ones first). A face is cut if any corner isn't in the patch.

    turned_over: the faces are seen from their other side. Their corners keep their order, in which the depth is summed up, so that its last digit, and with it the rank, stays.
    """
    m = rotation(*view_angles(hemi, view))
    both = vertices.join(curvature.select(*KEY, "vid", "value"), [*KEY, "vid"])
    c = mesh.corners(faces, both, ["x", "y", "z", "value"])
    outside = mesh.faces_touching(faces, vertices.join(patch_vertices, [*KEY, "vid"], "left_anti")).select(*KEY, "fid", F.lit(True).alias("_out"))
    n = metrics.face_normal(("0", "2", "1") if turned_over else ("0", "1", "2"))
    size = norm(n) + 1e-10
    turned = [sum((F.lit(w) * x for w, x in zip(row, n, strict=True)), F.lit(0.0)) / size for row in m]
    mid = [(F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3 for a in "xyz"]
    length = math.sqrt(sum(x * x for x in LIGHT))
    light = sum((F.lit(w / length) * t for w, t in zip(LIGHT, turned, strict=True)), F.lit(0.0))
    shade = AMBIENT + DIFFUSE * F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0))
    gray = F.when((F.col("value0") + F.col("value1") + F.col("value2")) / 3 > 0, 0.3).otherwise(0.7)
    shown = c.join(outside, [*KEY, "fid"], "left").where(turned[2] > 0)
    depth = sum((F.lit(w) * x for w, x in zip(m[2], mid, strict=True)), F.lit(0.0))
    out = shown.select(*KEY, "fid", F.col("_out").isNotNull().alias("is_cut"), F.when(F.col("_out").isNotNull(), F.least(0.8 + 0.2 * shade, F.lit(1.0))).otherwise(gray * shade).alias("shade"), depth.alias("depth"))
    return out.withColumn("depth_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("depth", "fid")))


def curvature_buckets(faces: DataFrame, curvature: DataFrame | None) -> DataFrame:
    """fid, mean curvature of the corners, gray level: .3 for sulci (> 0), .7 else; .6 and a null mean without curvature."""
    if curvature is None:
        return faces.select(*KEY, "fid", F.lit(None).cast("double").alias("curvature"), F.lit(0.6).alias("gray"))
    c = mesh.corners(faces, curvature, ["value"])
    mean = (F.col("value0") + F.col("value1") + F.col("value2")) / 3
    return c.select(*KEY, "fid", mean.alias("curvature"), F.when(mean > 0, 0.3).otherwise(0.7).alias("gray"))


def area_distortion(flat: DataFrame, solid: DataFrame) -> DataFrame:
    """fid, log2 of planar over 3-D area (clipped to 1e-6..1e6, 1 where the 3-D area is 0), its place in [-3, 3] as 0..1, is_flipped."""
    both = flat.join(solid.select(*KEY, "fid", F.col("area").alias("area_3d")), [*KEY, "fid"])
    ratio = F.when(F.col("area_3d") > 0, F.abs("area") / F.col("area_3d")).otherwise(1.0)
    log = F.log2(F.least(F.greatest(ratio, F.lit(1e-6)), F.lit(1e6)))
    return both.select(*KEY, "fid", log.alias("log2_ratio"), (F.least(F.greatest((log + 3) / 6, F.lit(0.0)), F.lit(1.0))).alias("level"), (F.col("area") < 0).alias("is_flipped"))


def flipped_centroids(faces: DataFrame, uv: DataFrame) -> DataFrame:
    c = mesh.corners(faces, uv, ["u", "v"]).join(metrics.planar_areas(faces, uv).where("area < 0").select(*KEY, "fid"), [*KEY, "fid"], "left_semi")
    return c.select(*KEY, "fid", *[((F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2")) / 3).alias(f"c{a}") for a in "uv"])


def area_percentiles(flat: DataFrame) -> DataFrame:
    """1st and 99th percentile of log10(|area| + 1e-10) over all meshes, linearly interpolated; null without faces."""
    return exact_percentiles(flat.select(F.log10(F.abs("area") + 1e-10).alias("a")), "a", {"p1": 0.01, "p99": 0.99})


def exact_percentiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row of percentiles by name. The values are sorted over all tasks by ranges; of the ranges' counts follows which of them hold the ranks."""
    spread = settled(df.select(F.col(column).alias("x")).where("x is not null").repartitionByRange("x").sortWithinPartitions("x").withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"), F.min("x").alias("low"))
    # as many rows as partitions
    starts = sizes.withColumn("before", F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))).select("part", "n", F.coalesce("before", F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranks = F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("total") - 1)).alias("at")) for k, p in wanted.items()])
    need = starts.select("part", "n", "before", F.explode(ranks).alias("w")).select("part", "n", "before", "w.name", "w.at", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("rank"))
    need = need.where("rank >= before and rank < before + n").select("part", "name", "at", "rank", (F.col("rank") - F.col("before")).alias("within"))
    held = spread.join(F.broadcast(need.select("part").distinct()), "part", "left_semi").withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1)
    found = held.join(F.broadcast(need), ["part", "within"]).groupBy("name").agg(F.min("x").alias("a"), F.max("x").alias("b"), (F.first("at") - F.floor(F.first("at"))).alias("share"))
    value = F.col("a") + F.col("share") * (F.col("b") - F.col("a"))
    return found.select("name", value.alias("v")).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in wanted])


def grid_layout(uv: DataFrame, *, meshes: int | None = None) -> DataFrame:
    """uv turned by a right angle (lh left, rh right) and centred on its bounding box."""
    turned = uv.select(*KEY, "vid", F.when(F.col("hemi") == "lh", -F.col("v")).otherwise(F.col("v")).alias("u"), F.when(F.col("hemi") == "lh", F.col("u")).otherwise(-F.col("u")).alias("v"))
    box = turned.groupBy(*KEY).agg(((F.max("u") + F.min("u")) / 2).alias("mu"), ((F.max("v") + F.min("v")) / 2).alias("mv"))
    return turned.join(mesh.each(box, meshes), KEY).select(*KEY, "vid", (F.col("u") - F.col("mu")).alias("u"), (F.col("v") - F.col("mv")).alias("v"))


def grid_limits(grid: DataFrame) -> DataFrame:
    """Limits of the flatmaps of subjects that have both hemispheres: half the longer side of each, the subject's larger one, and the largest of all."""
    half = (F.greatest(F.max("u") - F.min("u"), F.max("v") - F.min("v")) / 2).alias("half")
    boxes = settled(grid.groupBy(*KEY).agg(half))  # a row for each mesh from here on
    own = boxes.groupBy("subject").agg(F.max("half").alias("own_limit"), F.count("*").alias("n")).where("n = 2").drop("n")
    kept = boxes.join(own, "subject")
    return kept.join(F.broadcast(kept.agg(F.max("half").alias("shared_limit")))).select(*KEY, "half", "own_limit", "shared_limit")


def histogram_array(distortion: DataFrame, bins: int = 50, top: float = 100.0) -> DataFrame:
    """histogram: the counts of distortion_histogram() as an array of all bins, empty ones too."""
    counts = metrics.distortion_histogram(distortion, bins, top).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return counts.select(*KEY, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("histogram"))


def median_distortion(distortion: DataFrame) -> DataFrame:
    return distortion.groupBy(*KEY).agg(F.median("distortion").alias("median"), F.avg("distortion").alias("mean"))


