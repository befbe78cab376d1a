"""Energies of a planar embedding, their gradients, and single steps of the optimiser, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import softplus
from ..schema import KEY
from . import mesh, metrics
from .checkpoints import settled

STEEPNESS = 10.0
TINY = 1e-12


def _clip(x: Column, limit: float) -> Column:
    return F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))


def metric_energy(kring: DataFrame, uv: DataFrame) -> DataFrame:
    """J_d = sum of (length in the plane - dist) squared."""
    pairs = _with_length(kring, uv)
    return pairs.groupBy(*KEY).agg(F.sum((F.col("length") - F.col("dist")) * (F.col("length") - F.col("dist"))).alias("j_d"))


def _with_length(kring: DataFrame, uv: DataFrame) -> DataFrame:
    flat = metrics.with_plane_distance(kring, uv)
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    return flat.withColumns({"du": du, "dv": dv, "length": F.sqrt(du * du + dv * dv + TINY)})


def area_energy_softplus(areas: DataFrame, k: float = STEEPNESS) -> DataFrame:
    """The optimiser's area energy: sum of softplus(k A) / k - A with A clipped at 400 / k."""
    a = _clip(F.col("area"), 400 / k)
    return areas.groupBy(*KEY).agg(F.sum(softplus(k * a) / k - a).alias("j_a"))


def _with_original(areas: DataFrame, original: DataFrame | None) -> DataFrame:
    """Areas with those in space as area0; without `original` they have them, as from metrics.both_areas()."""
    if original is None:
        return areas
    return areas.join(original.select(*KEY, "fid", F.col("area").alias("area0")), [*KEY, "fid"])


def area_energy_sigmoid(areas: DataFrame, original: DataFrame | None = None, k: float = STEEPNESS) -> DataFrame:
    """Mean of the squared area change, weighted by the sigmoid of minus k times the clipped ratio."""
    both = _with_original(areas, original)
    ratio = _clip(F.col("area") / F.col("area0"), 400 / k)
    change = F.col("area") - F.col("area0")
    return both.groupBy(*KEY).agg(F.avg(change * change / (1 + F.exp(k * ratio))).alias("j_a"))


def area_energy_barrier(areas: DataFrame, original: DataFrame | None = None, k: float = STEEPNESS, weight: float = 0.1) -> DataFrame:
    """Mean of a softplus penalty and an inverse barrier on shares of the total area."""
    both = _with_original(areas, original)
    totals = both.groupBy(*KEY).agg((F.sum(F.abs("area")) + TINY).alias("all2"), F.sum("area0").alias("all3"))
    share = both.join(F.broadcast(totals), KEY).withColumn("r", (F.col("area") / F.col("all2")) / (F.col("area0") / F.col("all3")))
    clipped = _clip(F.col("r"), 400 / k)
    barrier = F.greatest(1 / F.greatest(F.col("r"), F.lit(0.01)) - 1, F.lit(0.0))
    return share.groupBy(*KEY).agg(F.avg(softplus(k * clipped) / k - clipped + weight * barrier).alias("j_a"))


def total_energy(kring: DataFrame, uv: DataFrame, areas: DataFrame, original: DataFrame | None = None, l_dist: float = 1.0, l_area: float = 1.0) -> DataFrame:
    """j_d, sigmoid j_a and their weighted sum."""
    both = metric_energy(kring, uv).join(area_energy_sigmoid(areas, original), KEY)
    return both.withColumn("total", l_dist * F.col("j_d") + l_area * F.col("j_a"))


def adaptive_weight(ratio: float, j_d: Column, j_a: Column) -> Column:
    """Weight of the area term that makes it `ratio` times the metric term."""
    return ratio * j_d / j_a


def ring_centroids(adj: DataFrame, uv: DataFrame) -> DataFrame:
    """vid, cu, cv: mean of the neighbours."""
    side = adj.join(uv.select(*KEY, F.col("vid").alias("dst"), "u", "v"), [*KEY, "dst"])
    return side.groupBy(*KEY, F.col("src").alias("vid")).agg(F.avg("u").alias("cu"), F.avg("v").alias("cv"))


def spring_displacement(adj: DataFrame, uv: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """vid, du, dv to the centroid of the neighbours; 0 for skipped vertices and those without neighbours."""
    moved = uv.join(ring_centroids(adj, uv), [*KEY, "vid"], "left")
    still = F.col("cu").isNull()
    if skip is not None:
        moved = moved.join(skip.select(*KEY, "vid", F.lit(True).alias("_skip")), [*KEY, "vid"], "left")
        still = still | F.col("_skip").isNotNull()
    return moved.select(*KEY, "vid", *[F.when(still, 0.0).otherwise(F.col(c) - F.col(p)).alias(d) for c, p, d in (("cu", "u", "du"), ("cv", "v", "dv"))])


def spring_energy(adj: DataFrame, uv: DataFrame) -> DataFrame:
    d = spring_displacement(adj, uv)
    return d.groupBy(*KEY).agg(F.sum(F.col("du") * F.col("du") + F.col("dv") * F.col("dv")).alias("j_s"))


def spring_round(adj: DataFrame, uv: DataFrame, faces: DataFrame, dt: float = 0.5, max_step: float = 1.0) -> DataFrame:
    """uv after one round of smoothing: boundary vertices outside flipped faces stay, steps are cut to max_step."""
    from .topology import boundary_vertices

    bad = metrics.vertices_in_flipped(metrics.planar_areas(faces, uv))
    skip = boundary_vertices(faces).join(bad, [*KEY, "vid"], "left_anti")
    step = uv.join(spring_displacement(adj, uv, skip), [*KEY, "vid"]).withColumns({"du": dt * F.col("du"), "dv": dt * F.col("dv")})
    size = F.sqrt(F.col("du") * F.col("du") + F.col("dv") * F.col("dv"))
    scale = F.when(size > max_step, max_step / size).otherwise(1.0)
    return step.select(*KEY, "vid", (F.col("u") + scale * F.col("du")).alias("u"), (F.col("v") + scale * F.col("dv")).alias("v"))


def closed(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """Neighbours with each vertex as a neighbour of its own, so that a round of smoothing is one join and one mean."""
    return adj.select(*KEY, "src", "dst").unionByName(vertices.select(*KEY, F.col("vid").alias("src"), F.col("vid").alias("dst")))


def _round(gradient: DataFrame, near: DataFrame) -> DataFrame:
    side = near.join(gradient.withColumnRenamed("vid", "dst"), [*KEY, "dst"])
    return side.groupBy(*KEY, F.col("src").alias("vid")).agg(F.avg("gu").alias("gu"), F.avg("gv").alias("gv"))


def smooth_once(gradient: DataFrame, adj: DataFrame) -> DataFrame:
    """(g + sum of the neighbours' g) / (degree + 1): vid, gu, gv."""
    return smooth(gradient, adj, 1)


#: Rounds of smoothing after which the lineage is cut, which bounds the size of the plan.
CUT_ROUNDS = 16


def smooth(gradient: DataFrame, adj: DataFrame, rounds: int) -> DataFrame:
    """Rounds of smooth_once(); the plan grows by one join a round."""
    if rounds <= 0:
        return gradient
    gradient = gradient.select(*KEY, "vid", "gu", "gv")
    if rounds > 1:
        gradient = settled(gradient)
    near = closed(adj, gradient)
    if rounds > 1:
        near = settled(near)
    for i in range(1, rounds + 1):
        gradient = _round(gradient, near)
        if i % CUT_ROUNDS == 0 and i < rounds:
            gradient = settled(gradient)
    return gradient


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEY, "vid").agg(F.sum("gu").alias("gu"), F.sum("gv").alias("gv"))


def metric_gradient(kring: DataFrame, uv: DataFrame) -> DataFrame:
    """dJ_d / duv per vertex, both ends of every pair."""
    return _summed(_metric_parts(kring, uv))


def _metric_parts(kring: DataFrame, uv: DataFrame) -> DataFrame:
    """vid, gu, gv: what every pair adds to either end."""
    pairs = _with_length(kring, uv)
    pull = 2 * (F.col("length") - F.col("dist")) / F.col("length")
    gu, gv = pull * F.col("du"), pull * F.col("dv")
    ends = F.array(F.struct(F.col("dst").alias("vid"), gu.alias("gu"), gv.alias("gv")), F.struct(F.col("src").alias("vid"), (-gu).alias("gu"), (-gv).alias("gv")))
    return pairs.select(*KEY, F.explode(ends).alias("g")).select(*KEY, "g.vid", "g.gu", "g.gv")


def area_gradient(faces: DataFrame, uv: DataFrame, k: float = STEEPNESS) -> DataFrame:
    """dJ_a / duv per vertex of the softplus energy; 0 from faces beyond the clip."""
    return _summed(_area_parts(faces, uv, k))


def _area_parts(faces: DataFrame, uv: DataFrame, k: float = STEEPNESS) -> DataFrame:
    """vid, gu, gv: what every face adds to its corners."""
    c = mesh.corners(faces, uv, ["u", "v"])
    u, v = [F.col(f"u{i}") for i in range(3)], [F.col(f"v{i}") for i in range(3)]
    area = 0.5 * ((u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0]))
    slope = F.when(F.abs(area) <= 400 / k, 1 / (1 + F.exp(-k * area)) - 1).otherwise(0.0)
    parts = [F.struct(F.col(n).alias("vid"), (0.5 * slope * (v[(i + 1) % 3] - v[(i + 2) % 3])).alias("gu"), (0.5 * slope * (u[(i + 2) % 3] - u[(i + 1) % 3])).alias("gv")) for i, n in enumerate("abc")]
    return c.select(*KEY, F.explode(F.array(*parts)).alias("g")).select(*KEY, "g.vid", "g.gu", "g.gv")


def weighted_gradient(kring: DataFrame, faces: DataFrame, uv: DataFrame, l_dist: float = 1.0, l_area: float = 1.0, *, n_pairs: DataFrame | None = None) -> DataFrame:
    """l_dist * g_d / average neighbours + l_area * g_a: vid, gu, gv for every vertex. The parts of both gradients are summed up by vertex at once.

    n_pairs: the pairs of each mesh as `pairs`, where they are known without counting kring.
    """
    if n_pairs is None:
        n_pairs = kring.groupBy(*KEY).agg(F.count("*").alias("pairs"))
    n_points = uv.groupBy(*KEY).agg(F.count("*").alias("points"))
    mean = F.broadcast(n_pairs.join(n_points, KEY).select(*KEY, (F.col("pairs") / F.col("points")).alias("mean")))
    d = _metric_parts(kring, uv).join(mean, KEY).select(*KEY, "vid", *[(l_dist * F.col(g) / F.col("mean")).alias(g) for g in ("gu", "gv")])
    a = _area_parts(faces, uv).select(*KEY, "vid", *[(l_area * F.col(g)).alias(g) for g in ("gu", "gv")])
    total = _summed(d.unionByName(a))
    return uv.select(*KEY, "vid").join(total, [*KEY, "vid"], "left").na.fill(0.0, ["gu", "gv"])


def gradient_summary(gradient: DataFrame) -> DataFrame:
    """norm of the whole gradient, and the mean and the largest amount of its components, by which steps are bounded."""
    u, v = F.abs("gu"), F.abs("gv")
    return gradient.groupBy(*KEY).agg(F.sqrt(F.sum(u * u + v * v)).alias("norm"), F.avg((u + v) / 2).alias("mean_abs"), F.max(F.greatest(u, v)).alias("max_abs"))


def line_search_energies(kring: DataFrame, faces: DataFrame, uv: DataFrame, gradient: DataFrame, steps: list[float], l_dist: float = 1.0, l_area: float = 1.0) -> DataFrame:
    """step, energy along minus the unit gradient: all steps in one pass per term, as columns of sums."""
    kring, gradient = settled(kring.select(*KEY, "src", "dst", "dist")), settled(gradient)
    size = F.broadcast(gradient.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("gu") * F.col("gu") + F.col("gv") * F.col("gv"))).alias("size")))
    moving = uv.join(gradient, [*KEY, "vid"]).join(size, KEY).select(*KEY, "vid", "u", "v", *[F.when(F.col("size") > 0, -F.col(g) / F.col("size")).otherwise(0.0).alias(d) for g, d in (("gu", "du"), ("gv", "dv"))])
    pairs = kring
    moving = settled(moving)
    for c, i in (("src", 0), ("dst", 1)):
        pairs = pairs.join(moving.select(*KEY, F.col("vid").alias(c), *[F.col(x).alias(f"{x}{i}") for x in ("u", "v", "du", "dv")]), [*KEY, c])
    tri = mesh.corners(faces, moving, ["u", "v", "du", "dv"])

    def length(s: float) -> Column:
        x = F.col("u1") - F.col("u0") + s * (F.col("du1") - F.col("du0"))
        y = F.col("v1") - F.col("v0") + s * (F.col("dv1") - F.col("dv0"))
        return F.sqrt(x * x + y * y + TINY)

    def penalty(s: float) -> Column:
        u, v = [F.col(f"u{i}") + s * F.col(f"du{i}") for i in range(3)], [F.col(f"v{i}") + s * F.col(f"dv{i}") for i in range(3)]
        a = _clip(0.5 * ((u[1] - u[0]) * (v[2] - v[0]) - (u[2] - u[0]) * (v[1] - v[0])), 400 / STEEPNESS)
        return softplus(STEEPNESS * a) / STEEPNESS - a

    d = pairs.groupBy(*KEY).agg(*[F.sum((length(s) - F.col("dist")) * (length(s) - F.col("dist"))).alias(f"d{i}") for i, s in enumerate(steps)])
    a = tri.groupBy(*KEY).agg(*[F.sum(penalty(s)).alias(f"a{i}") for i, s in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("step"), (l_dist * F.col(f"d{i}") + l_area * F.col(f"a{i}")).alias("energy")) for i, s in enumerate(steps)])
    return d.join(a, KEY).select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.i", "r.step", "r.energy")


def area_preserving_scale(areas: DataFrame, uv: DataFrame, target: DataFrame) -> DataFrame:
    """uv scaled about its centroid by sqrt(target area / (signed total + negative)); unchanged where that sum isn't positive."""
    factor = metrics.area_split(areas).join(target.select(*KEY, F.col("area").alias("target")), KEY)
    mid = uv.groupBy(*KEY).agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"))
    good = F.col("total") + F.col("negative")
    scale = factor.join(mid, KEY).select(*KEY, "mu", "mv", F.when(good > 0, F.sqrt(F.col("target") / good)).otherwise(1.0).alias("s"))
    return uv.join(F.broadcast(scale), KEY).select(*KEY, "vid", *[(F.col(m) + F.col("s") * (F.col(c) - F.col(m))).alias(c) for c, m in (("u", "mu"), ("v", "mv"))])


def initial_projection(vertices: DataFrame, normals: DataFrame, scale: float = 1.0, *, meshes: int | None = None) -> DataFrame:
    """Centre, turn the average normal to +Z, drop Z, scale about the centroid: vid, u, v."""
    mid = vertices.groupBy(*KEY).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    turn = metrics.average_normal(normals).join(mid, KEY).withColumn("d", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")))
    moved = vertices.join(mesh.each(turn, meshes), KEY)
    x, y, z = (F.col(a) - F.col(f"m{a}") for a in "xyz")
    nx, ny, nz, d = (F.col(c) for c in ("nx", "ny", "nz", "d"))
    level = d <= 1e-6
    u = F.when(level, x).otherwise(x * nx * nz / d + y * ny * nz / d - z * d)
    v = F.when(level, y).otherwise(y * nx / d - x * ny / d)
    return moved.select(*KEY, "vid", (scale * u).alias("u"), (scale * v).alias("v"))
