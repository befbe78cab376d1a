"""Every query by name over meshes made of the driver's tables, and DuckDB SQL for the same rows.

Queries without SQL run group kernels whose results SQL can't express; tests check them against small meshes worked out by hand.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FlattenConfig
from ..operators import cuts, energy, flatten, mesh, metrics, report, rings, snapshots, template, topology
from ..operators.checkpoints import settled
from ..schema import KEY
from ..sources import files
from ..streaming import telemetry
from .meshgen import Mesh, mesh_sql, table_mesh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, source: str = "orders", digits: int = 6) -> Callable:
    """Register a function of a mesh under its name; the result loses the key columns and doubles are rounded."""

    def wrap(f: Callable[[Mesh], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(table_mesh(spark, sf_dir, source))
            return out.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes if c not in KEY])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = mesh_sql(source) + sql
        return f

    return wrap


CORRECTION = metrics.CORRECTION
EDGES_FLAT = f"""
, k1 AS (SELECT src, dst, adj.w / {CORRECTION!r} AS dist, sqrt((q.u - o.u) * (q.u - o.u) + (q.v - o.v) * (q.v - o.v)) AS flat, q.u - o.u AS du, q.v - o.v AS dv,
                sqrt((q.u - o.u) * (q.u - o.u) + (q.v - o.v) * (q.v - o.v) + 1e-12) AS length
         FROM adj JOIN p o ON o.vid = src JOIN p q ON q.vid = dst)
"""
SOFTPLUS = "greatest(10 * a, 0) + ln(1 + exp(-abs(10 * a)))"


def graph(m: Mesh) -> DataFrame:
    return mesh.mesh_graph(m.faces, m.vertices)


def flat_areas(m: Mesh) -> DataFrame:
    return metrics.planar_areas(m.faces, m.uv)


def one_ring(m: Mesh) -> DataFrame:
    return metrics.k1_in_plane(m.faces, m.points)


def excluded(m: Mesh) -> DataFrame:
    return m.wall.unionByName(m.cut)


# --- flagship, edges, topology ----------------------------------------------------------------------------------------


@query(EDGES_FLAT + f"""
SELECT n_faces, n_flipped, round(area_2d_pos, 4) AS area_2d_pos, round(area_2d_neg, 4) AS area_2d_neg, round(j_a, 4) AS j_a, round(area_3d, 4) AS area_3d, round(pct_error, 4) AS pct_error, round(100.0 * n_flipped / n_faces, 4) AS flipped_pct
FROM (SELECT count(*) AS n_faces, count(*) FILTER (area2 < 0) AS n_flipped, coalesce(sum(area2) FILTER (area2 > 0), 0) AS area_2d_pos, coalesce(-sum(area2) FILTER (area2 < 0), 0) AS area_2d_neg, sum(0.5 * sqrt(nx * nx + ny * ny + nz * nz)) AS area_3d,
             sum((SELECT ({SOFTPLUS}) / 10 - a FROM (SELECT least(greatest(area2, -40), 40) AS a))) AS j_a FROM fa),
     (SELECT 100 * sum(abs(flat - dist)) / sum(dist) AS pct_error FROM k1 WHERE dist > 0)
""", digits=4)  # fmt: skip
def flatmap_report(m: Mesh) -> DataFrame:
    return report.points_report(m.points, m.faces)


@query("SELECT u, v, n_faces, round(len, 6) AS len FROM el")
def mesh_edges(m: Mesh) -> DataFrame:
    return mesh.edge_lengths(mesh.edges(m.faces), m.vertices)


@query("SELECT a.c AS n_vertices, b.c AS n_edges, d.c AS n_faces, a.c - b.c + d.c AS chi FROM (SELECT count(*) AS c FROM p) a, (SELECT count(*) AS c FROM e) b, (SELECT count(*) AS c FROM f) d")
def euler_characteristic(m: Mesh) -> DataFrame:
    return topology.euler(m.vertices, m.faces)


@query("SELECT u, v FROM e WHERE n_faces = 1")
def boundary_edges(m: Mesh) -> DataFrame:
    return topology.boundary_edges(m.faces)


@query("SELECT DISTINCT unnest([u, v]) AS vid FROM e WHERE n_faces = 1")
def boundary_vertices(m: Mesh) -> DataFrame:
    return topology.boundary_vertices(m.faces)


LEFT = "left_f AS (SELECT * FROM f WHERE a NOT IN (SELECT vid FROM {x}) AND b NOT IN (SELECT vid FROM {x}) AND c NOT IN (SELECT vid FROM {x}))"
EXCLUDED = ", x AS (SELECT vid FROM wall UNION SELECT vid FROM cutline), " + LEFT.format(x="x")
RIM = """, rim AS (SELECT least(s, t) AS u, greatest(s, t) AS v FROM (SELECT a AS s, b AS t FROM left_f UNION ALL SELECT b, c FROM left_f UNION ALL SELECT c, a FROM left_f) GROUP BY 1, 2 HAVING count(*) = 1),
r2 AS (SELECT u AS s, v AS t FROM rim UNION ALL SELECT v, u FROM rim)"""
REACH = ", reach(root, node) AS (SELECT DISTINCT s, s FROM r2 UNION SELECT root, t FROM reach JOIN r2 ON node = s)"


@query(", " + LEFT.format(x="wall") + RIM + REACH + " SELECT loop, count(*) AS n FROM (SELECT node AS vid, min(root) AS loop FROM reach GROUP BY node) GROUP BY loop", source="customer")
def boundary_loop_sizes(m: Mesh) -> DataFrame:
    return topology.boundary_loops(mesh.faces_without(m.faces, m.wall)).groupBy(*KEY, "loop").agg(F.count("*").alias("n"))


@query(", " + LEFT.format(x="wall") + RIM + REACH + """, loops AS (SELECT node AS vid, min(root) AS loop FROM reach GROUP BY node),
walk(loop, ord, vid, prev) AS (SELECT loop, 0, loop, (SELECT max(t) FROM r2 WHERE s = loop) FROM (SELECT DISTINCT loop FROM loops) UNION ALL SELECT loop, ord + 1, t, vid FROM walk JOIN r2 ON s = vid WHERE t <> prev AND t <> loop)
SELECT loop, CAST(ord AS INTEGER) AS ord, vid FROM walk""")  # fmt: skip
def boundary_walk(m: Mesh) -> DataFrame:
    return topology.boundary_paths(mesh.faces_without(m.faces, m.wall))


@query(", " + LEFT.format(x="wall") + RIM + REACH + """, loops AS (SELECT node AS vid, min(root) AS loop FROM reach GROUP BY node)
SELECT vid FROM loops WHERE loop = (SELECT loop FROM loops GROUP BY loop ORDER BY count(*) DESC, loop LIMIT 1)""", source="customer")  # fmt: skip
def longest_boundary_loop(m: Mesh) -> DataFrame:
    return topology.longest_loop(mesh.faces_without(m.faces, m.wall))


# --- patches -----------------------------------------------------------------------------------------------------------

PATCH = EXCLUDED + """, used AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM left_f), gone AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM f WHERE fid NOT IN (SELECT fid FROM left_f)),
patch AS (SELECT row_number() OVER (ORDER BY vid) - 1 AS pid, vid, p.x, p.y, p.z, vid IN (SELECT vid FROM gone) AS is_border FROM p WHERE vid IN (SELECT vid FROM used))"""


@query(PATCH + " SELECT pid, vid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, is_border FROM patch")
def patch_extract(m: Mesh) -> DataFrame:
    return mesh.build_patch(m.vertices, m.faces, excluded(m))


@query(PATCH + " SELECT fid, o.pid AS a, q.pid AS b, r.pid AS c FROM f JOIN patch o ON o.vid = a JOIN patch q ON q.vid = b JOIN patch r ON r.vid = c")
def patch_reindex(m: Mesh) -> DataFrame:
    return mesh.patch_faces(m.faces, mesh.build_patch(m.vertices, m.faces, excluded(m)))


@query(PATCH + " SELECT pid AS vid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM patch")
def isolated_removed(m: Mesh) -> DataFrame:
    return mesh.drop_isolated(m.vertices, mesh.faces_without(m.faces, excluded(m)))[0]


@query(PATCH + " SELECT (SELECT count(*) FROM x) AS n_excluded, count(*) AS n_included, count(*) FILTER (is_border) AS n_border FROM patch")
def patch_counts(m: Mesh) -> DataFrame:
    patch = mesh.build_patch(m.vertices, m.faces, excluded(m)).groupBy(*KEY).agg(F.count("*").alias("n_included"), F.count_if("is_border").alias("n_border"))
    return excluded(m).distinct().groupBy(*KEY).agg(F.count("*").alias("n_excluded")).join(patch, KEY)


@query(EXCLUDED + " SELECT fid FROM f WHERE fid NOT IN (SELECT fid FROM left_f)")
def cut_faces(m: Mesh) -> DataFrame:
    return mesh.faces_touching(m.faces, excluded(m)).select(*KEY, "fid")


@query(EXCLUDED + " SELECT vid FROM p WHERE vid NOT IN (SELECT unnest([a, b, c]) FROM left_f)")
def removed_vertices(m: Mesh) -> DataFrame:
    return mesh.removed_vertices(m.vertices, mesh.faces_without(m.faces, excluded(m)))


@query("SELECT vid, count(src) AS degree, count(src) > 2 AS is_high FROM p LEFT JOIN adj ON src = vid GROUP BY vid")
def vertex_degree(m: Mesh) -> DataFrame:
    return mesh.degrees(graph(m), m.vertices).withColumn("is_high", F.col("degree") > 2)


@query("SELECT vid, round((x + 2 * x + 1) / 2, 6) AS x, round((y + 3 - y / 7) / 2, 6) AS y, round((z + value / 37037) / 2, 6) AS z FROM p")
def mean_surface(m: Mesh) -> DataFrame:
    second = m.points.select(*KEY, "vid", (2 * F.col("x") + 1).alias("x"), (3 - F.col("y") / 7).alias("y"), (F.col("value") / 37037).alias("z"))
    return mesh.mean_surface(m.vertices, second)


@query("SELECT src, dst, round(w, 6) AS w FROM adj WHERE src IN (SELECT vid FROM wall) AND dst IN (SELECT vid FROM wall)")
def wall_graph(m: Mesh) -> DataFrame:
    return mesh.induced(graph(m), m.wall)


ISLANDS = """, isl AS (SELECT vid FROM p WHERE ix % 5 <> 4 AND iy % 7 <> 6), ie AS (SELECT src AS s, dst AS t FROM adj WHERE src IN (SELECT vid FROM isl) AND dst IN (SELECT vid FROM isl)),
reach(root, node) AS (SELECT vid, vid FROM isl UNION SELECT root, t FROM reach JOIN ie ON node = s), comp AS (SELECT node AS vid, min(root) AS comp FROM reach GROUP BY node)"""


def islands(m: Mesh) -> DataFrame:
    """The mesh without every fifth column and seventh row of vertices: many small components."""
    return m.points.where("ix % 5 <> 4 and iy % 7 <> 6").select(*KEY, "vid")


def island_parts(m: Mesh) -> DataFrame:
    own = mesh.induced(graph(m), islands(m))
    return topology.components(own.select(*KEY, F.col("src").alias("u"), F.col("dst").alias("v")), islands(m))


@query(ISLANDS + " SELECT vid, comp FROM comp", source="customer")
def components(m: Mesh) -> DataFrame:
    return island_parts(m)


@query(ISLANDS + " SELECT vid, comp FROM comp", source="part")
def components_by_joins(m: Mesh) -> DataFrame:
    own = mesh.induced(graph(m), islands(m))
    return topology.components(own.select(*KEY, F.col("src").alias("u"), F.col("dst").alias("v")), islands(m))


@query(ISLANDS + " SELECT comp, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, comp) AS rank FROM comp GROUP BY comp", source="customer")
def component_sizes(m: Mesh) -> DataFrame:
    return topology.component_sizes(island_parts(m))


@query(ISLANDS + """, s AS (SELECT comp, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, comp) AS rank FROM comp GROUP BY comp)
SELECT vid FROM comp WHERE comp IN (SELECT comp FROM s WHERE rank = 1 OR size > 20)""", source="customer")  # fmt: skip
def small_component_filter(m: Mesh) -> DataFrame:
    own = islands(m)
    return topology.drop_small_components(mesh.faces_within(m.faces, own), m.vertices.join(own, [*KEY, "vid"], "left_semi"))


@query(", x AS (SELECT vid FROM wall UNION SELECT vid FROM cutline), xe AS (SELECT src, dst FROM adj WHERE src IN (SELECT vid FROM x) AND dst IN (SELECT vid FROM x)), d AS (SELECT vid, count(src) AS n FROM x LEFT JOIN xe ON src = vid GROUP BY vid), "
       "he AS (SELECT src AS s, dst AS t FROM xe WHERE src IN (SELECT vid FROM d WHERE n > 2) AND dst IN (SELECT vid FROM d WHERE n > 2)), hr(root, node) AS (SELECT vid, vid FROM d WHERE n > 2 UNION SELECT root, t FROM hr JOIN he ON node = s), "
       "hc AS (SELECT node AS vid, min(root) AS comp FROM hr GROUP BY node), big AS (SELECT comp FROM hc GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1), w0 AS (SELECT vid, comp FROM hc WHERE comp IN (SELECT comp FROM big)), "
       "o AS (SELECT vid FROM x WHERE vid NOT IN (SELECT vid FROM w0)), oe AS (SELECT src AS s, dst AS t FROM xe WHERE src IN (SELECT vid FROM o) AND dst IN (SELECT vid FROM o)), orr(root, node) AS (SELECT vid, vid FROM o UNION SELECT root, t FROM orr JOIN oe ON node = s), "
       "oc AS (SELECT node AS vid, min(root) AS comp FROM orr GROUP BY node), k AS (SELECT comp, row_number() OVER (ORDER BY count(*) DESC, comp) AS part FROM oc GROUP BY comp) "
       "SELECT vid, CAST(0 AS INTEGER) AS part, comp FROM w0 UNION ALL SELECT vid, CAST(part AS INTEGER), oc.comp FROM oc JOIN k ON k.comp = oc.comp", source="customer")  # fmt: skip
def medial_wall_split(m: Mesh) -> DataFrame:
    return topology.wall_and_cuts(graph(m), excluded(m))


@query("SELECT DISTINCT src AS vid FROM adj WHERE src IN (SELECT vid FROM wall) AND dst NOT IN (SELECT vid FROM wall)")
def wall_border_inner(m: Mesh) -> DataFrame:
    return topology.inner_border(graph(m), m.wall)


@query("SELECT DISTINCT dst AS vid FROM adj WHERE src IN (SELECT vid FROM wall) AND dst NOT IN (SELECT vid FROM wall)")
def wall_border_outer(m: Mesh) -> DataFrame:
    return topology.outer_border(graph(m), m.wall)


@query(", " + LEFT.format(x="wall") + RIM + REACH + """, loops AS (SELECT node AS vid, min(root) AS loop FROM reach GROUP BY node), ends AS (SELECT s AS vid, count(*) AS n FROM r2 GROUP BY s)
SELECT vid FROM ends WHERE n > 2 UNION ALL SELECT vid FROM loops WHERE (SELECT max(n) FROM ends) <= 2 AND loop <> (SELECT loop FROM loops GROUP BY loop ORDER BY count(*) DESC, loop LIMIT 1)""", source="customer")  # fmt: skip
def hole_fill_round(m: Mesh) -> DataFrame:
    return topology.hole_fill_round(m.faces, m.wall)


def fill_sql(rounds: int) -> str:
    """The rounds of hole filling one after the other: faces left, their rim, its loops, and what goes: vertices of crossed loops, else all loops but the longest."""
    out = ", gone0 AS (SELECT vid FROM wall)"
    for i in range(rounds):
        out += f""", lf{i} AS (SELECT * FROM f WHERE a NOT IN (SELECT vid FROM gone{i}) AND b NOT IN (SELECT vid FROM gone{i}) AND c NOT IN (SELECT vid FROM gone{i})),
rm{i} AS (SELECT least(s, t) AS u, greatest(s, t) AS v FROM (SELECT a AS s, b AS t FROM lf{i} UNION ALL SELECT b, c FROM lf{i} UNION ALL SELECT c, a FROM lf{i}) GROUP BY 1, 2 HAVING count(*) = 1),
bo{i} AS (SELECT u AS s, v AS t FROM rm{i} UNION ALL SELECT v, u FROM rm{i}), re{i}(root, node) AS (SELECT DISTINCT s, s FROM bo{i} UNION SELECT root, t FROM re{i} JOIN bo{i} ON node = s),
lo{i} AS (SELECT node AS vid, min(root) AS loop FROM re{i} GROUP BY node), en{i} AS (SELECT s AS vid, count(*) AS n FROM bo{i} GROUP BY s),
gone{i + 1} AS (SELECT vid FROM gone{i} UNION SELECT vid FROM en{i} WHERE n > 2 UNION SELECT vid FROM lo{i} WHERE (SELECT max(n) FROM en{i}) <= 2 AND loop <> (SELECT loop FROM lo{i} GROUP BY loop ORDER BY count(*) DESC, loop LIMIT 1))"""
    return out + f" SELECT vid FROM gone{rounds} WHERE vid NOT IN (SELECT vid FROM wall)"


@query(fill_sql(10), source="customer")
def hole_fill(m: Mesh) -> DataFrame:
    return topology.fill_holes(m.faces, m.wall)


# --- areas and normals ---------------------------------------------------------------------------------------------------


@query("SELECT fid, a, b, c, round(area2, 6) AS area FROM fa")
def triangle_area_2d(m: Mesh) -> DataFrame:
    return flat_areas(m)


@query("SELECT count(*) FILTER (area2 < 0) AS n_flipped, count(*) AS n_faces FROM fa")
def flipped_strict(m: Mesh) -> DataFrame:
    return metrics.flipped(flat_areas(m))


@query("SELECT count(*) FILTER (area2 <= 0) AS n_flipped, count(*) AS n_faces FROM fa")
def flipped_nonpositive(m: Mesh) -> DataFrame:
    return metrics.flipped(flat_areas(m), strict=False)


@query("SELECT fid, round(0.5 * sqrt(nx * nx + ny * ny + nz * nz), 6) AS area FROM fa")
def face_area_3d(m: Mesh) -> DataFrame:
    return metrics.face_areas_3d(m.faces, m.vertices)


@query("SELECT round(sum(0.5 * sqrt(nx * nx + ny * ny + nz * nz)), 4) AS area FROM fa", digits=4)
def surface_area_3d(m: Mesh) -> DataFrame:
    return metrics.surface_area(m.faces, m.vertices)


@query("SELECT round(sum(area2), 4) AS total, round(sum(greatest(-area2, 0)), 4) AS negative FROM fa", digits=4)
def area_split(m: Mesh) -> DataFrame:
    return metrics.area_split(flat_areas(m))


@query("SELECT DISTINCT unnest([a, b, c]) AS vid FROM fa WHERE area2 < 0")
def vertices_in_flipped_faces(m: Mesh) -> DataFrame:
    return metrics.vertices_in_flipped(flat_areas(m))


NORMALS = """, vs AS (SELECT vid, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM (SELECT unnest([a, b, c]) AS vid, nx, ny, nz FROM fa) GROUP BY vid),
vn AS (SELECT vid, sx / sqrt(sx * sx + sy * sy + sz * sz) AS nx, sy / sqrt(sx * sx + sy * sy + sz * sz) AS ny, sz / sqrt(sx * sx + sy * sy + sz * sz) AS nz FROM vs)"""


@query(NORMALS + " SELECT vid, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM vn")
def vertex_normals(m: Mesh) -> DataFrame:
    return metrics.vertex_normals(m.faces, m.vertices)


AVERAGE = NORMALS + ", an AS (SELECT x / sqrt(x * x + y * y + z * z) AS nx, y / sqrt(x * x + y * y + z * z) AS ny, z / sqrt(x * x + y * y + z * z) AS nz FROM (SELECT sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM vn))"


@query(AVERAGE + " SELECT round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM an")
def average_normal(m: Mesh) -> DataFrame:
    return metrics.average_normal(metrics.vertex_normals(m.faces, m.vertices))


# --- rings and geodesics -------------------------------------------------------------------------------------------------


def ring_sql(k: int) -> str:
    out = ", h1 AS (SELECT src, dst, 1 AS hop FROM adj), s1 AS (SELECT * FROM h1)"
    for h in range(2, k + 1):
        out += f", h{h} AS (SELECT DISTINCT x.src, a.dst, {h} AS hop FROM h{h - 1} x JOIN adj a ON a.src = x.dst WHERE a.dst <> x.src AND NOT EXISTS (SELECT 1 FROM s{h - 1} s WHERE s.src = x.src AND s.dst = a.dst)), s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT * FROM h{h})"
    return out


@query(ring_sql(3) + " SELECT hop, count(*) AS n_pairs FROM s3 GROUP BY hop")
def kring_counts(m: Mesh) -> DataFrame:
    return rings.ring_counts(rings.block_rings(graph(m), 3))


@query(ring_sql(2) + " SELECT src, dst, hop FROM s2", source="customer")
def kring_pairs(m: Mesh) -> DataFrame:
    return rings.krings(graph(m), 2)


@query(ring_sql(2) + " SELECT src, dst, hop FROM s2", source="part")
def kring_pairs_by_blocks(m: Mesh) -> DataFrame:
    return rings.block_rings(graph(m), 2)


@query(ring_sql(2) + " SELECT round(avg(n), 6) AS avg_neighbours FROM (SELECT count(*) AS n FROM s2 GROUP BY src)")
def average_neighbours(m: Mesh) -> DataFrame:
    return rings.average_neighbours(rings.block_rings(graph(m), 2))


WALKS = ring_sql(2) + """, walk(src, dst, d, n) AS (SELECT src, dst, w, 1 FROM adj UNION ALL
  SELECT src, dst, min(d), n FROM (SELECT x.src, a.dst, x.d + a.w AS d, x.n + 1 AS n FROM walk x JOIN adj a ON a.src = x.dst WHERE x.n < 6 AND a.dst <> x.src) GROUP BY src, dst, n),
geo AS (SELECT src, dst, hop, min(d) / {c!r} AS dist FROM walk JOIN s2 USING (src, dst) GROUP BY src, dst, hop)""".replace("{c!r}", repr(CORRECTION))


@query(WALKS + " SELECT src, dst, hop, round(dist, 6) AS dist FROM geo", source="customer")
def kring_geodesic(m: Mesh) -> DataFrame:
    return rings.geodesics(graph(m), 2)


@query(WALKS + " SELECT src, dst, hop, round(dist, 6) AS dist FROM geo", source="customer")
def kring_geodesic_by_joins(m: Mesh) -> DataFrame:
    adj = settled(graph(m))
    return rings.relaxed_distances(adj, rings.krings(adj, 2), 6)


TANGENT = NORMALS + """, tp AS (SELECT src, dst, dx, dy, dz, n.nx, n.ny, n.nz, CASE WHEN abs(n.nx) < 0.9 THEN 1.0 ELSE 0.0 END AS rx, CASE WHEN abs(n.nx) < 0.9 THEN 0.0 ELSE 1.0 END AS ry
  FROM (SELECT src, dst, q.x - o.x AS dx, q.y - o.y AS dy, q.z - o.z AS dz FROM adj JOIN p o ON o.vid = src JOIN p q ON q.vid = dst) JOIN vn n ON n.vid = src),
t1 AS (SELECT *, rx - (rx * nx + ry * ny) * nx AS tx, ry - (rx * nx + ry * ny) * ny AS ty, -(rx * nx + ry * ny) * nz AS tz FROM tp),
t2 AS (SELECT src, dst, dx, dy, dz, nx, ny, nz, tx / l AS tx, ty / l AS ty, tz / l AS tz FROM (SELECT *, sqrt(tx * tx + ty * ty + tz * tz) AS l FROM t1)),
t3 AS (SELECT src, dst, dx * tx + dy * ty + dz * tz AS p, dx * (ny * tz - nz * ty) + dy * (nz * tx - nx * tz) + dz * (nx * ty - ny * tx) AS q FROM t2),
t4 AS (SELECT *, CASE WHEN atan2(q, p) < 0 THEN atan2(q, p) + 2 * pi() ELSE atan2(q, p) END AS angle FROM t3)"""


def angled(m: Mesh) -> DataFrame:
    ring = mesh.neighbour_pairs(m.faces).withColumn("hop", F.lit(1))
    return rings.tangent_positions(ring, m.vertices, metrics.vertex_normals(m.faces, m.vertices))


@query(TANGENT + " SELECT src, dst, round(p, 6) AS p, round(q, 6) AS q FROM t4")
def tangent_projection(m: Mesh) -> DataFrame:
    return angled(m).select(*KEY, "src", "dst", "p", "q")


@query(TANGENT + """, c AS (SELECT *, count(*) OVER (PARTITION BY src) AS n, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS r FROM t4),
x AS (SELECT src, dst, s AS slot, least(abs(angle - s * pi() / 2), 2 * pi() - abs(angle - s * pi() / 2)) AS diff FROM c, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE n > 4),
y AS (SELECT *, row_number() OVER (PARTITION BY src, slot ORDER BY diff, dst) AS k FROM x)
SELECT src, dst, CAST(r AS INTEGER) AS slot FROM c WHERE n <= 4 UNION ALL SELECT src, dst, CAST(min(slot) AS INTEGER) FROM y WHERE k = 1 AND diff < pi() / 2 GROUP BY src, dst""")  # fmt: skip
def angular_sampling(m: Mesh) -> DataFrame:
    return rings.angular_samples(angled(m), 4).select(*KEY, "src", "dst", F.col("slot").cast("int").alias("slot"))


@query(source="customer")
def angular_kring(m: Mesh) -> DataFrame:
    return flatten.ring_distances(m.vertices, m.faces, FlattenConfig())


# --- distortion ----------------------------------------------------------------------------------------------------------


@query(EDGES_FLAT + " SELECT round(100 * sum(abs(flat - dist)) / sum(dist), 4) AS pct_error FROM k1 WHERE dist > 0", digits=4)
def distance_error(m: Mesh) -> DataFrame:
    return metrics.distance_error(one_ring(m), m.uv)


DISTORTION = EDGES_FLAT + ", vd AS (SELECT vid, coalesce(100 * avg(abs(flat - dist)) / avg(dist), 0) AS d FROM p LEFT JOIN k1 ON src = vid GROUP BY vid)"


@query(DISTORTION + " SELECT vid, round(d, 6) AS distortion FROM vd")
def vertex_distortion(m: Mesh) -> DataFrame:
    return metrics.vertex_distortion(one_ring(m), m.uv)


@query(DISTORTION + " SELECT CAST(least(floor(least(greatest(d, 0), 100) / 2), 49) AS INTEGER) AS bin, count(*) AS n FROM vd GROUP BY 1")
def distortion_histogram(m: Mesh) -> DataFrame:
    return metrics.distortion_histogram(metrics.vertex_distortion(one_ring(m), m.uv))


@query(DISTORTION + " SELECT round(median(d), 6) AS median, round(avg(d), 6) AS mean FROM vd")
def distortion_median(m: Mesh) -> DataFrame:
    return report.median_distortion(metrics.vertex_distortion(one_ring(m), m.uv))


# --- energies and optimiser steps ------------------------------------------------------------------------------------------


@query(EDGES_FLAT + " SELECT round(sum((length - dist) * (length - dist)), 4) AS j_d FROM k1", digits=4)
def metric_energy(m: Mesh) -> DataFrame:
    return energy.metric_energy(one_ring(m), m.uv)


@query(f"SELECT round(sum(({SOFTPLUS}) / 10 - a), 4) AS j_a FROM (SELECT least(greatest(area2, -40), 40) AS a FROM fa)", digits=4)
def area_energy_softplus(m: Mesh) -> DataFrame:
    return energy.area_energy_softplus(flat_areas(m))


ORIGINAL = ", o3 AS (SELECT *, 0.5 * sqrt(nx * nx + ny * ny + nz * nz) AS area3 FROM fa)"
SIGMOID = "avg((area2 - area3) * (area2 - area3) / (1 + exp(10 * least(greatest(area2 / area3, -40), 40))))"


@query(ORIGINAL + f" SELECT round({SIGMOID}, 6) AS j_a FROM o3")
def area_energy_sigmoid(m: Mesh) -> DataFrame:
    return energy.area_energy_sigmoid(metrics.both_areas(m.faces, m.points))


@query(ORIGINAL + f""", s AS (SELECT sum(abs(area2)) + 1e-12 AS all2, sum(area3) AS all3 FROM o3), r AS (SELECT (area2 / all2) / (area3 / all3) AS r, least(greatest((area2 / all2) / (area3 / all3), -40), 40) AS a FROM o3, s)
SELECT round(avg(({SOFTPLUS}) / 10 - a + 0.1 * greatest(1 / greatest(r, 0.01) - 1, 0)), 6) AS j_a FROM r""")  # fmt: skip
def area_energy_barrier(m: Mesh) -> DataFrame:
    return energy.area_energy_barrier(metrics.both_areas(m.faces, m.points))


@query(EDGES_FLAT + ORIGINAL + f" SELECT round(d, 4) AS j_d, round(a, 4) AS j_a, round(d + a, 4) AS total FROM (SELECT sum((length - dist) * (length - dist)) AS d FROM k1), (SELECT {SIGMOID} AS a FROM o3)", digits=4)
def total_energy(m: Mesh) -> DataFrame:
    return energy.total_energy(one_ring(m), m.uv, metrics.both_areas(m.faces, m.points))


CENTROIDS = ", rc AS (SELECT src AS vid, avg(q.u) AS cu, avg(q.v) AS cv FROM adj JOIN p q ON q.vid = dst GROUP BY src)"


@query(CENTROIDS + " SELECT vid, round(coalesce(cu - u, 0), 6) AS du, round(coalesce(cv - v, 0), 6) AS dv FROM p LEFT JOIN rc USING (vid)")
def spring_displacement(m: Mesh) -> DataFrame:
    return energy.spring_displacement(graph(m), m.uv)


@query(CENTROIDS + " SELECT round(sum((cu - u) * (cu - u) + (cv - v) * (cv - v)), 4) AS j_s FROM p JOIN rc USING (vid)", digits=4)
def spring_energy(m: Mesh) -> DataFrame:
    return energy.spring_energy(graph(m), m.uv)


@query(CENTROIDS + """, bad AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM fa WHERE area2 < 0), stay AS (SELECT DISTINCT unnest([u, v]) AS vid FROM e WHERE n_faces = 1 EXCEPT SELECT vid FROM bad),
st AS (SELECT p.vid, u, v, CASE WHEN s.vid IS NULL THEN 0.5 * (cu - u) ELSE 0 END AS du, CASE WHEN s.vid IS NULL THEN 0.5 * (cv - v) ELSE 0 END AS dv FROM p JOIN rc USING (vid) LEFT JOIN stay s ON s.vid = p.vid)
SELECT vid, round(u + CASE WHEN sqrt(du * du + dv * dv) > 1 THEN 1 / sqrt(du * du + dv * dv) ELSE 1 END * du, 6) AS u, round(v + CASE WHEN sqrt(du * du + dv * dv) > 1 THEN 1 / sqrt(du * du + dv * dv) ELSE 1 END * dv, 6) AS v FROM st""")  # fmt: skip
def spring_round(m: Mesh) -> DataFrame:
    return energy.spring_round(graph(m), m.uv, m.faces)


def smooth_sql(rounds: int) -> str:
    out = ", g0 AS (SELECT vid, u AS gu, v AS gv FROM p)"
    for i in range(rounds):
        out += f", g{i + 1} AS (SELECT g.vid, (any_value(g.gu) + coalesce(sum(n.gu), 0)) / (count(n.vid) + 1) AS gu, (any_value(g.gv) + coalesce(sum(n.gv), 0)) / (count(n.vid) + 1) AS gv FROM g{i} g LEFT JOIN adj ON src = g.vid LEFT JOIN g{i} n ON n.vid = dst GROUP BY g.vid)"
    return out + f" SELECT vid, round(gu, 6) AS gu, round(gv, 6) AS gv FROM g{rounds}"


@query(smooth_sql(1))
def gradient_smooth_step(m: Mesh) -> DataFrame:
    return energy.smooth_once(m.uv.withColumnsRenamed({"u": "gu", "v": "gv"}), graph(m))


@query(smooth_sql(4))
def gradient_smooth_4(m: Mesh) -> DataFrame:
    return energy.smooth(m.uv.withColumnsRenamed({"u": "gu", "v": "gv"}), graph(m), 4)


GRADIENT = EDGES_FLAT + """, gd AS (SELECT vid, sum(gu) AS gu, sum(gv) AS gv FROM (SELECT dst AS vid, 2 * (length - dist) / length * du AS gu, 2 * (length - dist) / length * dv AS gv FROM k1 UNION ALL SELECT src, -2 * (length - dist) / length * du, -2 * (length - dist) / length * dv FROM k1) GROUP BY vid),
sl AS (SELECT *, CASE WHEN abs(area2) <= 40 THEN 0.5 * (1 / (1 + exp(-10 * area2)) - 1) ELSE 0 END AS s FROM fa),
ga AS (SELECT vid, sum(gu) AS gu, sum(gv) AS gv FROM (SELECT a AS vid, s * (v1 - v2) AS gu, s * (u2 - u1) AS gv FROM sl UNION ALL SELECT b, s * (v2 - v0), s * (u0 - u2) FROM sl UNION ALL SELECT c, s * (v0 - v1), s * (u1 - u0) FROM sl) GROUP BY vid),
mean AS (SELECT (SELECT count(*) FROM k1) / (SELECT count(*) FROM p)::DOUBLE AS n),
g AS (SELECT p.vid, p.u, p.v, coalesce(gd.gu / n, 0) + coalesce(ga.gu, 0) AS gu, coalesce(gd.gv / n, 0) + coalesce(ga.gv, 0) AS gv FROM p CROSS JOIN mean LEFT JOIN gd ON gd.vid = p.vid LEFT JOIN ga ON ga.vid = p.vid)"""


def gradient(m: Mesh) -> DataFrame:
    n_pairs = mesh.later_neighbours(m.faces).groupBy(*KEY).agg((2 * F.sum(F.size("near"))).alias("pairs"))
    return energy.weighted_gradient(one_ring(m), m.faces, m.uv, n_pairs=n_pairs)


@query(GRADIENT + " SELECT vid, round(gu, 6) AS gu, round(gv, 6) AS gv FROM g")
def weighted_gradient(m: Mesh) -> DataFrame:
    return gradient(m)


@query(GRADIENT + " SELECT round(sqrt(sum(gu * gu + gv * gv)), 4) AS norm, round(avg((abs(gu) + abs(gv)) / 2), 4) AS mean_abs, round(max(greatest(abs(gu), abs(gv))), 4) AS max_abs FROM g", digits=4)
def gradient_summary(m: Mesh) -> DataFrame:
    return energy.gradient_summary(gradient(m))


STEPS = [10.0 ** (k / 4 - 2.5) for k in range(15)]


@query(GRADIENT + f""", way AS (SELECT vid, u, v, -gu / l AS du, -gv / l AS dv FROM g, (SELECT sqrt(sum(gu * gu + gv * gv)) AS l FROM g)), st AS (SELECT i, s FROM (SELECT unnest(range({len(STEPS)})) AS i, unnest({STEPS!r}::DOUBLE[]) AS s)),
ld AS (SELECT i, sum((l - dist) * (l - dist)) AS d FROM (SELECT i, dist, sqrt((y.u - x.u + s * (y.du - x.du)) * (y.u - x.u + s * (y.du - x.du)) + (y.v - x.v + s * (y.dv - x.dv)) * (y.v - x.v + s * (y.dv - x.dv)) + 1e-12) AS l FROM k1 JOIN way x ON x.vid = src JOIN way y ON y.vid = dst, st) GROUP BY i),
la AS (SELECT i, sum(({SOFTPLUS}) / 10 - a) AS e FROM (SELECT i, least(greatest(0.5 * ((u1 - u0) * (v2 - v0) - (u2 - u0) * (v1 - v0)), -40), 40) AS a FROM
  (SELECT i, x.u + s * x.du AS u0, x.v + s * x.dv AS v0, y.u + s * y.du AS u1, y.v + s * y.dv AS v1, z.u + s * z.du AS u2, z.v + s * z.dv AS v2 FROM f JOIN way x ON x.vid = a JOIN way y ON y.vid = b JOIN way z ON z.vid = c, st)) GROUP BY i)
SELECT CAST(st.i AS INTEGER) AS i, round(s, 3) AS step, round(d + e, 3) AS energy FROM st JOIN ld ON ld.i = st.i JOIN la ON la.i = st.i""", source="customer", digits=3)  # fmt: skip
def line_search_energies(m: Mesh) -> DataFrame:
    return energy.line_search_energies(one_ring(m), m.faces, m.uv, gradient(m), STEPS)


@query("""SELECT vid, round(mu + s * (u - mu), 6) AS u, round(mv + s * (v - mv), 6) AS v FROM p, (SELECT avg(u) AS mu, avg(v) AS mv FROM p),
(SELECT sqrt(sum(0.5 * sqrt(nx * nx + ny * ny + nz * nz)) / (sum(area2) + sum(greatest(-area2, 0)))) AS s FROM fa)""")
def area_preserving_scale(m: Mesh) -> DataFrame:
    return energy.area_preserving_scale(flat_areas(m), m.uv, metrics.surface_area(m.faces, m.vertices))


@query(AVERAGE + """, c AS (SELECT vid, x - mx AS x, y - my AS y, z - mz AS z FROM p, (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p)), d AS (SELECT *, sqrt(nx * nx + ny * ny) AS d FROM an)
SELECT vid, round(3 * CASE WHEN d <= 1e-6 THEN x ELSE x * nx * nz / d + y * ny * nz / d - z * d END, 6) AS u, round(3 * CASE WHEN d <= 1e-6 THEN y ELSE y * nx / d - x * ny / d END, 6) AS v FROM c, d""")  # fmt: skip
def initial_projection(m: Mesh) -> DataFrame:
    return energy.initial_projection(m.vertices, metrics.vertex_normals(m.faces, m.vertices), 3.0)


# --- cuts and template -----------------------------------------------------------------------------------------------------


def placed(m: Mesh, members: DataFrame) -> DataFrame:
    return m.vertices.join(members, [*KEY, "vid"], "left_semi")


GAP = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"SELECT a.vid, b.vid AS near, round({GAP}, 6) AS distance FROM p a, p b WHERE a.vid IN (SELECT vid FROM wall) AND b.vid IN (SELECT unnest([u, v]) FROM e WHERE n_faces = 1) ORDER BY {GAP}, a.vid, b.vid LIMIT 1", source="customer")
def nearest_set_distance(m: Mesh) -> DataFrame:
    return cuts.set_distance(placed(m, m.wall), placed(m, topology.boundary_vertices(m.faces)))


@query(f"SELECT a.vid, min_by(b.vid, {GAP}) AS near, round(min({GAP}), 6) AS distance FROM p a, p b WHERE a.vid IN (SELECT vid FROM cutline) AND b.vid IN (SELECT vid FROM wall) GROUP BY a.vid", source="customer")
def nearest_vertices(m: Mesh) -> DataFrame:
    return cuts.nearest(placed(m, m.cut), placed(m, m.wall))


@query(f"SELECT a.vid AS p, b.vid AS q, round({GAP}, 6) AS distance FROM p a, p b WHERE a.vid < b.vid AND a.vid IN (SELECT vid FROM cutline) AND b.vid IN (SELECT vid FROM cutline) ORDER BY {GAP} DESC LIMIT 1", source="customer")
def farthest_pair(m: Mesh) -> DataFrame:
    return cuts.farthest_pair(placed(m, m.cut))


@query(f"SELECT b.vid, round({GAP}, 6) AS distance FROM p a, p b WHERE a.vid = 0 ORDER BY {GAP} DESC, b.vid LIMIT 1")
def farthest_vertex(m: Mesh) -> DataFrame:
    return cuts.farthest_from(m.vertices, m.vertices.where("vid = 0"))


@query(f"SELECT DISTINCT a.vid FROM p a, p b WHERE a.vid IN (SELECT unnest([u, v]) FROM e WHERE n_faces = 1) AND b.vid IN (SELECT vid FROM cutline) AND {GAP} < 5", source="customer")
def distance_theta_candidates(m: Mesh) -> DataFrame:
    return cuts.within(placed(m, topology.boundary_vertices(m.faces)), placed(m, m.cut), 5.0)


@query(""", far AS (SELECT src, dst, w FROM adj), sp(node, d, n) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION ALL SELECT dst, min(d + far.w), n + 1 FROM sp JOIN far ON src = node WHERE n < 40 GROUP BY dst, n)
SELECT CAST(0 AS BIGINT) AS src, vid AS dst, round(min(d), 6) AS length FROM sp JOIN p ON node = vid WHERE vid = 7 * p.w + 9 GROUP BY vid""", source="customer")  # fmt: skip
def shortest_path_length(m: Mesh) -> DataFrame:
    return shortest_path_vertices(m).groupBy(*KEY, "src", "dst").agg(F.max("length").alias("length"))


@query(""", sp(node, d, n) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION ALL SELECT dst, min(d + adj.w), n + 1 FROM sp JOIN adj ON src = node WHERE n < 40 GROUP BY dst, n),
far AS (SELECT node, min(d) AS d FROM sp GROUP BY node), prev AS (SELECT dst AS node, min_by(src, d + adj.w) AS back FROM adj JOIN far ON node = src WHERE dst <> 0 GROUP BY dst),
goal AS (SELECT vid FROM p WHERE vid = 7 * p.w + 9), trace(vid, n) AS (SELECT vid, 0 FROM goal UNION ALL SELECT back, n + 1 FROM trace JOIN prev ON node = vid WHERE vid <> 0)
SELECT CAST(0 AS BIGINT) AS src, goal.vid AS dst, CAST((SELECT max(n) FROM trace) - n AS INTEGER) AS ord, trace.vid, round(far.d, 6) AS length FROM trace, goal JOIN far ON far.node = goal.vid""", source="customer")  # fmt: skip
def shortest_path_vertices(m: Mesh) -> DataFrame:
    pair = m.vertices.where("vid = 0").select(*KEY, F.lit(0).cast("long").alias("src"), F.lit(7 * m.width + 9).cast("long").alias("dst"))
    return cuts.shortest_paths(graph(m), pair)


def corner_wall(m: Mesh) -> DataFrame:
    """A diagonal that shuts the corner of vertex 0 off."""
    return m.points.where("ix + iy = 9 or ix + iy = 10").select(*KEY, "vid")


@query("SELECT vid FROM p WHERE ix + iy < 9", source="customer")
def trapped_vertices(m: Mesh) -> DataFrame:
    return cuts.trapped(graph(m), m.vertices, corner_wall(m), 9)


def broken_cut(m: Mesh) -> DataFrame:
    """The cut line with a gap, as `calcarine`."""
    return m.points.join(m.cut, [*KEY, "vid"], "left_semi").where("ix % 6 < 4").select(*KEY, F.lit("calcarine").alias("name"), "vid", F.col("ix").cast("int").alias("ord"))


@query(source="customer")
def continuous_cuts(m: Mesh) -> DataFrame:
    return cuts.continuous(graph(m), m.vertices, broken_cut(m))


@query(source="customer")
def geodesic_cuts(m: Mesh) -> DataFrame:
    return cuts.refine(graph(m), m.vertices, broken_cut(m), m.wall)


@query("SELECT vid FROM p WHERE ix + iy <= 10")
def isolated_region_absorb(m: Mesh) -> DataFrame:
    diagonal = corner_wall(m).select(*KEY, F.lit("temporal").alias("name"), "vid", F.lit(0).alias("ord"))
    return cuts.absorb(graph(m), m.vertices, diagonal, m.wall).select(*KEY, "vid")


@query(f"SELECT 'calcarine' AS name, b.vid, CAST(min(a.ix) AS INTEGER) AS ord FROM p a, p b WHERE a.vid IN (SELECT vid FROM cutline) AND b.vid = (SELECT c.vid FROM p c WHERE c.ix % 2 = 0 ORDER BY (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) + (a.z - c.z) * (a.z - c.z), c.vid LIMIT 1) GROUP BY b.vid", source="customer")
def cuts_by_nearest(m: Mesh) -> DataFrame:
    """Cuts carried to a coarser surface: every second column of vertices."""
    own = m.points.join(m.cut, [*KEY, "vid"], "left_semi").select(*KEY, F.lit("calcarine").alias("name"), "vid", F.col("ix").cast("int").alias("ord"))
    return cuts.map_by_nearest(own, m.vertices, placed(m, m.points.where("ix % 2 = 0")))


@query(source="customer")
def merge_small_components(m: Mesh) -> DataFrame:
    own = island_parts(m)
    parts = own.join(topology.component_sizes(own), [*KEY, "comp"]).select(*KEY, "vid", F.col("rank").cast("int").alias("part"))
    return template.merge_small(parts, topology.inner_border(graph(m), m.wall), m.vertices)


AXES = """, cv AS (SELECT var_pop(y) AS a, covar_pop(y, z) AS b, var_pop(z) AS d FROM p WHERE vid IN (SELECT vid FROM wall)), th AS (SELECT 0.5 * atan2(2 * b, a - d) AS t FROM cv), fx AS (SELECT cos(t) AS fy, sin(t) AS fz FROM th),
ax AS (SELECT CASE WHEN abs(fy) <= abs(fz) THEN fy ELSE -fz END AS y1, CASE WHEN abs(fy) <= abs(fz) THEN fz ELSE fy END AS z1, CASE WHEN abs(fy) <= abs(fz) THEN -fz ELSE fy END AS y2, CASE WHEN abs(fy) <= abs(fz) THEN fy ELSE fz END AS z2 FROM fx),
axes AS (SELECT CASE WHEN z1 < 0 THEN -y1 ELSE y1 END AS p1_y, CASE WHEN z1 < 0 THEN -z1 ELSE z1 END AS p1_z, CASE WHEN y2 < 0 THEN -y2 ELSE y2 END AS p2_y, CASE WHEN y2 < 0 THEN -z2 ELSE z2 END AS p2_z FROM ax)"""


@query(AXES + " SELECT round(p1_y, 6) AS p1_y, round(p1_z, 6) AS p1_z, round(p2_y, 6) AS p2_y, round(p2_z, 6) AS p2_z FROM axes")
def pca_yz(m: Mesh) -> DataFrame:
    return template.wall_axes(placed(m, m.wall))


@query(AXES + """, bands AS (SELECT CAST(1 + iy * 5 // w AS INTEGER) AS part, y, z FROM p), pc AS (SELECT part, avg(y * p1_y + z * p1_z) AS pc1, avg(y * p2_y + z * p2_z) AS pc2 FROM bands, axes GROUP BY part),
lo AS (SELECT *, row_number() OVER (ORDER BY pc1, part) = 1 AS low FROM pc), rk AS (SELECT *, row_number() OVER (ORDER BY low, pc2, part) AS r FROM lo)
SELECT part, CASE WHEN low THEN 'temporal' ELSE ['calcarine', 'medial1', 'medial2', 'medial3'][r] END AS name, round(pc1, 6) AS pc1, round(pc2, 6) AS pc2 FROM rk""")  # fmt: skip
def anatomical_naming(m: Mesh) -> DataFrame:
    bands = m.points.select(*KEY, "vid", F.expr(f"cast(1 + iy * 5 div {m.width} as int)").alias("part"))
    return template.name_cuts(bands, m.vertices, placed(m, m.wall))


@query(source="customer")
def template_derivation(m: Mesh) -> DataFrame:
    return template.derive(m.vertices, m.faces, mesh.faces_without(m.faces, excluded(m)))


# --- optimiser and snapshots -------------------------------------------------------------------------------------------------

@query(source="customer")
def flatten_kernel(m: Mesh) -> DataFrame:
    config = FlattenConfig()
    shots = flatten.optimise(m.vertices, m.faces, flatten.ring_distances(m.vertices, m.faces, config), flatten.initial(m.vertices, m.faces, config), config, keep_every=5)
    return shots.select(*KEY, "step", "phase", "iteration", "j_d", "j_a", "n_flipped")


def trail(m: Mesh) -> DataFrame:
    """A made snapshot of every vertex: two points that drift, in three phases of a third each."""
    n = m.width * m.width
    phase = F.when(F.col("vid") * 3 < n, "epoch_1").when(F.col("vid") * 3 < 2 * n, "epoch_2").otherwise("smoothing")
    points = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct((F.col("u") + 2).alias("u"), (F.col("v") - F.col("x")).alias("v")))
    return m.points.select(*KEY, (F.col("vid") + 1).cast("int").alias("step"), phase.alias("phase"), F.col("vid").cast("int").alias("iteration"), (1e6 - F.col("vid") + F.col("x")).alias("j_d"), F.col("y").alias("j_a"), (n - F.col("vid") % 7 * 3 - F.col("vid")).cast("int").alias("n_flipped"), points.alias("uv"))


TRAIL = ", tr AS (SELECT CAST(vid + 1 AS INTEGER) AS step, w * w AS n, CASE WHEN vid * 3 < w * w THEN 'epoch_1' WHEN vid * 3 < 2 * w * w THEN 'epoch_2' ELSE 'smoothing' END AS phase, 1e6::DOUBLE - vid + x AS j_d, y AS j_a, CAST(w * w - vid % 7 * 3 - vid AS INTEGER) AS n_flipped, u, v, x FROM p)"


@query(TRAIL + ", ids AS (SELECT DISTINCT CAST(round_even(i * (w * w - 1) / 24.0::DOUBLE, 0) AS INTEGER) + 1 AS step FROM (SELECT unnest(range(25)) AS i), n) SELECT step FROM ids")
def snapshot_sampling(m: Mesh) -> DataFrame:
    return snapshots.sampled(trail(m), 25).select(*KEY, "step")


@query(TRAIL + " SELECT step FROM tr WHERE step % 10 = 0 OR step = 1")
def snapshot_every_nth(m: Mesh) -> DataFrame:
    return snapshots.every_nth(trail(m), 10).select(*KEY, "step")


@query(TRAIL + """, h AS (SELECT step, 1 + CASE WHEN step = 1 THEN 15 ELSE 0 END + CASE WHEN phase <> lead(phase) OVER (ORDER BY step) THEN 7 ELSE 0 END + CASE WHEN step = n THEN 30 ELSE 0 END AS times FROM tr)
SELECT step, CAST(row_number() OVER (ORDER BY step) - 1 AS INTEGER) AS frame_idx FROM (SELECT step, unnest(range(times)) FROM h)""")  # fmt: skip
def frame_holds(m: Mesh) -> DataFrame:
    return snapshots.with_holds(trail(m), 15.0, 1.0, 0.5, 2.0).select(*KEY, "step", F.col("frame_idx").cast("int").alias("frame_idx"))


@query(TRAIL + " SELECT step, round(u + 1, 6) AS cx, round((v + v - x) / 2, 6) AS cy, round(greatest(2, abs(x)) / 2, 6) AS half FROM tr")
def frame_boxes(m: Mesh) -> DataFrame:
    return snapshots.boxes(trail(m))


@query(TRAIL + " SELECT step, (CASE phase WHEN 'epoch_1' THEN 'Epoch 1' WHEN 'epoch_2' THEN 'Epoch 2' ELSE 'Smoothing' END) || ' ' || (step - 1) AS label FROM tr")
def frame_labels(m: Mesh) -> DataFrame:
    return snapshots.labels(trail(m))


CHANGES = TRAIL + ", ch AS (SELECT step, phase, j_d + j_a AS energy, (lag(j_d + j_a) OVER w - (j_d + j_a)) / lag(j_d + j_a) OVER w AS rel_change, min(n_flipped) OVER (ORDER BY step) AS best_flipped FROM tr WINDOW w AS (PARTITION BY phase ORDER BY step))"


@query(CHANGES + " SELECT step, phase, round(energy, 6) AS energy, round(rel_change, 6) AS rel_change FROM ch")
def energy_trace_delta(m: Mesh) -> DataFrame:
    return snapshots.energy_changes(trail(m)).drop("best_flipped")


@query(CHANGES + " SELECT step, best_flipped FROM ch")
def best_so_far(m: Mesh) -> DataFrame:
    return snapshots.energy_changes(trail(m)).select(*KEY, "step", "best_flipped")


@query(TRAIL + " SELECT phase, count(*) AS steps, round(min(j_d + j_a), 6) AS lowest, min(n_flipped) AS fewest_flipped, max(step) AS last_step FROM tr GROUP BY phase")
def snapshot_progress(m: Mesh) -> DataFrame:
    return telemetry.progress(trail(m))


# --- report tables -----------------------------------------------------------------------------------------------------------


@query("SELECT fid, round((c0 + c1 + c2) / 3, 6) AS curvature, CASE WHEN (c0 + c1 + c2) / 3 > 0 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS gray FROM fc")
def face_curvature_bucket(m: Mesh) -> DataFrame:
    return report.curvature_buckets(m.faces, m.points.select(*KEY, "vid", "value"))


@query(ORIGINAL + ", l AS (SELECT fid, log2(least(greatest(CASE WHEN area3 > 0 THEN abs(area2) / area3 ELSE 1 END, 1e-6), 1e6)) AS l, area2 < 0 AS is_flipped FROM o3) SELECT fid, round(l, 6) + 0.0 AS log2_ratio, round(least(greatest((l + 3) / 6, 0), 1), 6) AS level, is_flipped FROM l")
def area_distortion_log2(m: Mesh) -> DataFrame:
    return report.area_distortion(flat_areas(m), metrics.face_areas_3d(m.faces, m.vertices))


@query("SELECT fid, round((u0 + u1 + u2) / 3, 6) AS cu, round((v0 + v1 + v2) / 3, 6) AS cv FROM fa WHERE area2 < 0")
def flipped_centroids(m: Mesh) -> DataFrame:
    return report.flipped_centroids(m.faces, m.uv)


def view_sql(elevation: float, azimuth: float, *, turned_over: bool = False) -> str:
    r, length = report.rotation(elevation, azimuth), math.sqrt(sum(x * x for x in report.LIGHT))
    turned = [" + ".join(f"({w!r}) * n{a}" for w, a in zip(row, "xyz", strict=True)) for row in r]
    if turned_over:
        turned = [f"-({t})" for t in turned]
    light = " + ".join(f"({w / length!r}) * t{i}" for i, w in enumerate(report.LIGHT))
    depth = " + ".join(f"({w!r}) * (({a}0 + {a}1 + {a}2) / 3)" for w, a in zip(r[2], "xyz", strict=True))
    return EXCLUDED + f""", inside AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM left_f), s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) + 1e-10 AS l FROM fa), t AS (SELECT *, ({turned[0]}) / l AS t0, ({turned[1]}) / l AS t1, ({turned[2]}) / l AS t2, {depth} AS depth FROM s),
h AS (SELECT *, 0.4 + 0.6 * least(greatest({light}, 0), 1) AS h, a NOT IN (SELECT vid FROM inside) OR b NOT IN (SELECT vid FROM inside) OR c NOT IN (SELECT vid FROM inside) AS is_cut FROM t WHERE t2 > 0)
SELECT fid, is_cut, round(CASE WHEN is_cut THEN least(0.8 + 0.2 * h, 1) WHEN (c0 + c1 + c2) / 3 > 0 THEN 0.3 * h ELSE 0.7 * h END, 5) AS shade, round(depth, 5) AS depth, CAST(row_number() OVER (ORDER BY depth, fid) AS INTEGER) AS depth_rank FROM h"""


def _view(name: str) -> None:
    """The view from below sees the mesh turned over: its faces run the other way, so that some are seen at all."""

    def run(m: Mesh) -> DataFrame:
        patch = mesh.used_vertices(mesh.faces_without(m.faces, excluded(m)))
        return report.view_faces(m.vertices, m.faces, m.points.select(*KEY, "vid", "value"), patch, "lh", name, turned_over=name == "ventral")

    run.__name__ = f"projection_view_{name}"
    query(view_sql(*report.view_angles("lh", name), turned_over=name == "ventral"), digits=5)(run)


for _name in ("medial", "ventral", "frontal"):
    _view(_name)


@query("SELECT round(quantile_cont(log10(abs(area2) + 1e-10), 0.01), 6) AS p1, round(quantile_cont(log10(abs(area2) + 1e-10), 0.99), 6) AS p99 FROM fa")
def area_percentiles(m: Mesh) -> DataFrame:
    return report.area_percentiles(flat_areas(m))


@query("SELECT vid, round(-v + (max(v) OVER () + min(v) OVER ()) / 2, 6) AS u, round(u - (max(u) OVER () + min(u) OVER ()) / 2, 6) AS v FROM p")
def grid_layout(m: Mesh) -> DataFrame:
    return report.grid_layout(m.uv)


# --- files ---------------------------------------------------------------------------------------------------------------------


@query(PATCH + " SELECT pid, vid, round(CAST(x AS FLOAT)::DOUBLE, 4) AS x, round(CAST(y AS FLOAT)::DOUBLE, 4) AS y, round(CAST(z AS FLOAT)::DOUBLE, 4) AS z, is_border FROM patch", digits=4)
def patch_roundtrip(m: Mesh) -> DataFrame:
    return files.decode_patches(files.encode_patches(mesh.build_patch(m.vertices, m.faces, excluded(m))))


@query("SELECT vid, round(CAST(value AS FLOAT)::DOUBLE, 3) AS value FROM p", digits=3)
def curvature_roundtrip(m: Mesh) -> DataFrame:
    return files.decode_curvatures(files.encode_curvatures(m.points.select(*KEY, "vid", "value")))


@query("SELECT vid FROM wall")
def label_roundtrip(m: Mesh) -> DataFrame:
    return files.parse_labels(files.label_lines(m.wall, m.vertices))


@query("SELECT 'mwall' AS name, vid, CAST(row_number() OVER (ORDER BY vid) - 1 AS INTEGER) AS ord FROM wall UNION ALL SELECT 'calcarine', vid, CAST(row_number() OVER (ORDER BY vid) - 1 AS INTEGER) FROM cutline")
def template_filter(m: Mesh) -> DataFrame:
    both = m.wall.withColumn("name", F.lit("mwall")).unionByName(m.cut.withColumn("name", F.lit("calcarine"))).withColumn("ord", F.col("vid"))
    other = both.withColumn("hemi", F.lit("rh"))
    return files.parse_template(files.template_json(both.unionByName(other)), "lh")


@query("SELECT vid AS flipped, round(vid / 4.0, 2)::DOUBLE AS distance_error, 'sub-' || vid AS name, CASE WHEN vid % 2 = 0 THEN 'lh' ELSE 'rh' END AS hemisphere FROM p")
def log_parse(m: Mesh) -> DataFrame:
    hemi = F.when(F.col("vid") % 2 == 0, "lh").otherwise("rh")
    text = F.concat(F.lit("Input patch: /data/sub-"), F.col("vid"), F.lit("/surf/"), hemi, F.lit(".patch.3d\nsome line\nFINAL RESULT\nFlipped triangles: 900 -> "), F.col("vid"), F.lit("\nMean % distance error: "), F.format_string("%.2f", F.col("vid") / 4.0), F.lit("%\n"))
    return files.parse_logs(m.points.select(text.alias("value"))).withColumnRenamed("subject", "name")
