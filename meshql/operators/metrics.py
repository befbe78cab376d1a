"""Areas, flips, distortion and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cross, distance, norm, signed_area, sub, vec
from ..schema import KEY
from . import mesh

#: Graph distances are divided by this constant.
CORRECTION = (1 + 2**0.5) / 2


def planar_areas(faces: DataFrame, uv: DataFrame) -> DataFrame:
    """Signed area of every face in the plane: fid, area."""
    c = mesh.corners(faces, uv, ["u", "v"])
    return c.select(*KEY, "fid", "a", "b", "c", signed_area(vec("0", "uv"), vec("1", "uv"), vec("2", "uv")).alias("area"))


def face_normal(suffix: tuple[str, str, str] = ("0", "1", "2")) -> tuple[Column, ...]:
    p, q, r = (vec(s) for s in suffix)
    return cross(sub(q, p), sub(r, p))


def face_areas_3d(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return mesh.corners(faces, vertices, ["x", "y", "z"]).select(*KEY, "fid", (0.5 * norm(face_normal())).alias("area"))


def both_areas(faces: DataFrame, points: DataFrame) -> DataFrame:
    """fid, area in the plane (signed) and area0 in space of every face, from points with x, y, z, u, v: each corner is joined once for both."""
    c = mesh.corners(faces, points, ["x", "y", "z", "u", "v"])
    return c.select(*KEY, "fid", signed_area(vec("0", "uv"), vec("1", "uv"), vec("2", "uv")).alias("area"), (0.5 * norm(face_normal())).alias("area0"))


def surface_area(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return face_areas_3d(faces, vertices).groupBy(*KEY).agg(F.sum("area").alias("area"))


def flipped(areas: DataFrame, *, strict: bool = True) -> DataFrame:
    """Faces turned over: negative area, or with strict=False area of zero too."""
    bad = F.col("area") < 0 if strict else F.col("area") <= 0
    return areas.groupBy(*KEY).agg(F.count_if(bad).alias("n_flipped"), F.count("*").alias("n_faces"))


def area_split(areas: DataFrame) -> DataFrame:
    """Signed total and the sum of the negative areas' amounts."""
    a = F.col("area")
    return areas.groupBy(*KEY).agg(F.sum(a).alias("total"), F.sum(F.when(a < 0, -a).otherwise(0.0)).alias("negative"))


def vertices_in_flipped(areas: DataFrame) -> DataFrame:
    return mesh.used_vertices(areas.where("area < 0"))


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Unit normals, faces weighted by area: a face's cross product is twice its area long already."""
    n = face_normal()
    each = mesh.corners(faces, vertices, ["x", "y", "z"]).select(*KEY, F.explode(F.array("a", "b", "c")).alias("vid"), *[c.alias(f"n{a}") for c, a in zip(n, "xyz", strict=True)])
    total = each.groupBy(*KEY, "vid").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = norm((F.col("nx"), F.col("ny"), F.col("nz")))
    return total.select(*KEY, "vid", *[F.when(size > 0, F.col(f"n{a}") / size).otherwise(0.0).alias(f"n{a}") for a in "xyz"])


def average_normal(normals: DataFrame) -> DataFrame:
    total = normals.groupBy(*KEY).agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    size = norm((F.col("nx"), F.col("ny"), F.col("nz")))
    return total.select(*KEY, *[(F.col(f"n{a}") / size).alias(f"n{a}") for a in "xyz"])


def with_plane_distance(kring: DataFrame, uv: DataFrame) -> DataFrame:
    """Ring pairs with the distance of their ends in the plane as `flat`. Pairs that bring their ends' coordinates, as those of k1_in_plane() do, aren't joined again."""
    out = kring
    for c, i in () if "u0" in kring.columns else (("src", 0), ("dst", 1)):
        out = out.join(uv.select(*KEY, F.col("vid").alias(c), F.col("u").alias(f"u{i}"), F.col("v").alias(f"v{i}")), [*KEY, c])
    return out.withColumn("flat", norm(sub(vec("1", "uv"), vec("0", "uv"))))


def distance_error(kring: DataFrame, uv: DataFrame) -> DataFrame:
    """100 * sum |flat - dist| / sum dist over pairs with a positive dist."""
    pairs = with_plane_distance(kring, uv).where("dist > 0")
    return pairs.groupBy(*KEY).agg((100 * F.sum(F.abs(F.col("flat") - F.col("dist"))) / F.sum("dist")).alias("pct_error"))


def vertex_distortion(kring: DataFrame, uv: DataFrame) -> DataFrame:
    """Per vertex 100 * mean |flat - dist| / mean dist; 0 without neighbours or with mean 0."""
    pairs = with_plane_distance(kring, uv).where("dist > 0")
    each = pairs.groupBy(*KEY, F.col("src").alias("vid")).agg(F.avg(F.abs(F.col("flat") - F.col("dist"))).alias("off"), F.avg("dist").alias("mean"))
    pct = F.when(F.col("mean") > 0, 100 * F.col("off") / F.col("mean")).otherwise(0.0)
    return uv.select(*KEY, "vid").join(each, [*KEY, "vid"], "left").select(*KEY, "vid", F.coalesce(pct, F.lit(0.0)).alias("distortion"))


def ring_errors(kring: DataFrame, uv: DataFrame) -> DataFrame:
    """pct_error as distance_error() gives it and worst_distortion, the largest of vertex_distortion(), of each mesh: pairs are met with their ends and grouped by vertex once for both."""
    pairs = with_plane_distance(kring, uv).where("dist > 0")
    each = pairs.groupBy(*KEY, "src").agg(F.sum(F.abs(F.col("flat") - F.col("dist"))).alias("off"), F.sum("dist").alias("all"), F.count("*").alias("n"))
    return each.groupBy(*KEY).agg((100 * F.sum("off") / F.sum("all")).alias("pct_error"), F.max(100 * (F.col("off") / F.col("n")) / (F.col("all") / F.col("n"))).alias("worst_distortion"))


def distortion_histogram(distortion: DataFrame, bins: int = 50, top: float = 100.0) -> DataFrame:
    """Counts by bin of values clipped to [0, top]; the last bin is closed."""
    clipped = F.least(F.greatest(F.col("distortion"), F.lit(0.0)), F.lit(top))
    return distortion.select(*KEY, F.least(F.floor(clipped / (top / bins)), F.lit(bins - 1)).cast("int").alias("bin")).groupBy(*KEY, "bin").agg(F.count("*").alias("n"))


def k1_distances(lengths: DataFrame) -> DataFrame:
    """1-ring pairs: a straight edge is never longer than a detour, so dist is the edge over the correction."""
    return mesh.adjacency(lengths).select(*KEY, "src", "dst", F.lit(1).alias("hop"), (F.col("w") / CORRECTION).alias("dist"))


def k1_in_plane(faces: DataFrame, points: DataFrame) -> DataFrame:
    """k1_distances() with u0, v0, u1, v1, the plane's coordinates of both ends, from points with x, y, z, u, v.

    An edge is joined once with either end, for space and plane together, before it is turned into two pairs: what is shuffled are vertices' lists of neighbours and each edge once.
    """

    def side(c: str, i: int) -> DataFrame:
        return points.select(*KEY, F.col("vid").alias(c), *[F.col(a).alias(f"{a}{i}") for a in "xyzuv"])

    edges = mesh.later_neighbours(faces).join(side("src", 0), [*KEY, "src"]).withColumn("dst", F.explode("near")).join(side("dst", 1), [*KEY, "dst"])
    dist = (distance(vec("0"), vec("1")) / CORRECTION).alias("dist")
    ways = F.array(*[F.struct(F.col(s).alias("src"), F.col(t).alias("dst"), *[F.col(f"{a}{o}").alias(f"{a}{n}") for n, o in enumerate(order) for a in "uv"]) for s, t, order in (("src", "dst", (0, 1)), ("dst", "src", (1, 0)))])
    pairs = edges.select(*KEY, dist, F.explode(ways).alias("e"))
    return pairs.select(*KEY, "e.src", "e.dst", F.lit(1).alias("hop"), "dist", "e.u0", "e.v0", "e.u1", "e.v1")
