"""Meshes made of other tables: height fields over dense keys, plain grids, half spheres."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import unsent


@dataclass(frozen=True)
class Mesh:
    """points: subject, hemi, vid, ix, iy, x, y, z, u, v, value; width: vertices of a grid's side."""

    points: DataFrame
    faces: DataFrame
    width: int

    @property
    def vertices(self) -> DataFrame:
        return self.points.select("subject", "hemi", "vid", "x", "y", "z")

    @property
    def uv(self) -> DataFrame:
        return self.points.select("subject", "hemi", "vid", "u", "v")

    def block(self, low: float, high: float) -> Column:
        """Whether a vertex lies in the square block between two fractions of the width."""
        a, b = int(self.width * low), int(self.width * high)
        return F.col("ix").between(a, b - 1) & F.col("iy").between(a, b - 1)

    @property
    def wall(self) -> DataFrame:
        """The medial wall's vertices: a block in the middle."""
        return self.points.where(self.block(0.4, 0.6)).select("subject", "hemi", "vid")

    @property
    def cut(self) -> DataFrame:
        """A line of vertices from the wall to the left rim; with it removed the rest is a disk."""
        low, high = int(self.width * 0.4), int(self.width * 0.6)
        return self.points.where((F.col("iy") == (low + high) // 2) & (F.col("ix") < low)).select("subject", "hemi", "vid")


#: Columns of the source tables by mesh: key, horizontal jitter terms (column, modulus), height, value.
SOURCES = {
    "orders": ("o_orderkey", ("o_custkey", 97), ("o_custkey", 89), "o_totalprice / 1e6", "o_totalprice - 250000", "o_custkey"),
    "customer": ("c_custkey", ("c_nationkey", 23), ("c_custkey", 19), "c_acctbal / 2e4", "c_acctbal - 4500", "c_custkey"),
    "part": ("p_partkey", ("p_size", 47), ("p_partkey", 31), "p_retailprice / 1e3", "p_retailprice - 1400", "p_partkey"),
}


def grid_faces(cells: DataFrame, width: int) -> DataFrame:
    """Two counter-clockwise faces for every cell of a grid. cells: subject, hemi, vid, ix, iy of all vertices."""
    v, w = F.col("vid"), F.lit(width)
    inner = cells.where((F.col("ix") < width - 1) & (F.col("iy") < width - 1))
    corner = F.array(F.struct(v.alias("a"), (v + 1).alias("b"), (v + w).alias("c")), F.struct((v + 1).alias("a"), (v + w + 1).alias("b"), (v + w).alias("c")))
    return inner.select("subject", "hemi", "vid", F.posexplode(corner).alias("k", "t")).select("subject", "hemi", (2 * v + F.col("k")).alias("fid"), "t.a", "t.b", "t.c")


def table_mesh(spark: SparkSession, sf_dir: str, name: str = "orders", subject: str = "s1", hemi: str = "lh") -> Mesh:
    """Height field over a table with dense keys from 0: a disk of floor(sqrt(rows)) squared vertices."""
    key, jx, jy, height, value, flat = SOURCES[name]
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    width = int(rows.count() ** 0.5)  # from the files' footers
    vid = F.col(key).cast("long")
    base = rows.where(F.col(key) < width * width).select(
        F.lit(subject).alias("subject"), F.lit(hemi).alias("hemi"), vid.alias("vid"), (vid % width).alias("ix"), F.expr(f"{key} div {width}").alias("iy"),
        (0.2 * ((F.col(jx[0]) % jx[1]) / F.lit(float(jx[1])))).alias("dx"), (0.2 * ((F.col(jy[0]) % jy[1]) / F.lit(float(jy[1])))).alias("dy"),
        F.expr(height).cast("double").alias("z"), F.expr(value).cast("double").alias("value"),
        (0.9 * ((F.col(flat) % 7) / F.lit(7.0))).alias("du"), (0.9 * ((F.col(flat) % 11) / F.lit(11.0))).alias("dv"),
    )
    base = unsent(base, width * width)
    x, y = F.col("ix") + F.col("dx"), F.col("iy") + F.col("dy")
    points = base.select("subject", "hemi", "vid", "ix", "iy", x.alias("x"), y.alias("y"), "z", (x + F.col("du")).alias("u"), (y + F.col("dv")).alias("v"), "value")
    return Mesh(points, grid_faces(base.select("subject", "hemi", "vid", "ix", "iy"), width), width)


def mesh_sql(name: str = "orders") -> str:
    """The same mesh as common table expressions of DuckDB: n, p (points), f (faces), wall, cutline."""
    key, jx, jy, height, value, flat = SOURCES[name]
    return f"""
WITH RECURSIVE n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM {name}),
p AS (
  SELECT vid, ix, iy, w, x, y, z, x + du AS u, y + dv AS v, value FROM (
    SELECT CAST({key} AS BIGINT) AS vid, {key} % w AS ix, {key} // w AS iy, w,
           ({key} % w) + 0.2 * (({jx[0]} % {jx[1]}) / {jx[1]}.0::DOUBLE) AS x, ({key} // w) + 0.2 * (({jy[0]} % {jy[1]}) / {jy[1]}.0::DOUBLE) AS y,
           CAST({height} AS DOUBLE) AS z, CAST({value} AS DOUBLE) AS value,
           0.9 * (({flat} % 7) / 7.0::DOUBLE) AS du, 0.9 * (({flat} % 11) / 11.0::DOUBLE) AS dv
    FROM {name}, n WHERE {key} < w * w)
),
f AS (
  SELECT 2 * vid AS fid, vid AS a, vid + 1 AS b, vid + w AS c FROM p WHERE ix < w - 1 AND iy < w - 1
  UNION ALL SELECT 2 * vid + 1, vid + 1, vid + w + 1, vid + w FROM p WHERE ix < w - 1 AND iy < w - 1
),
wall AS (SELECT vid FROM p WHERE ix >= floor(0.4 * w) AND ix < floor(0.6 * w) AND iy >= floor(0.4 * w) AND iy < floor(0.6 * w)),
cutline AS (SELECT vid FROM p WHERE iy = (CAST(floor(0.4 * w) AS BIGINT) + CAST(floor(0.6 * w) AS BIGINT)) // 2 AND ix < floor(0.4 * w)),
e AS (SELECT least(s, t) AS u, greatest(s, t) AS v, count(*) AS n_faces FROM (SELECT a AS s, b AS t FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f) GROUP BY 1, 2),
el AS (SELECT e.u, e.v, e.n_faces, sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) + (q.z - o.z) * (q.z - o.z)) AS len FROM e JOIN p o ON o.vid = e.u JOIN p q ON q.vid = e.v),
adj AS (SELECT u AS src, v AS dst, len AS w FROM el UNION ALL SELECT v, u, len FROM el),
fc AS (SELECT f.*, o.x AS x0, o.y AS y0, o.z AS z0, o.u AS u0, o.v AS v0, q.x AS x1, q.y AS y1, q.z AS z1, q.u AS u1, q.v AS v1, r.x AS x2, r.y AS y2, r.z AS z2, r.u AS u2, r.v AS v2,
              o.value AS c0, q.value AS c1, r.value AS c2
       FROM f JOIN p o ON o.vid = a JOIN p q ON q.vid = b JOIN p r ON r.vid = c),
fa AS (SELECT *, 0.5 * ((u1 - u0) * (v2 - v0) - (u2 - u0) * (v1 - v0)) AS area2,
              (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM fc)
"""


def plain_grid(spark: SparkSession, width: int, subject: str = "grid", hemi: str = "lh") -> Mesh:
    """A flat grid with unit spacing; uv are its own coordinates."""
    vid = F.col("id")
    points = spark.range(width * width).select(
        F.lit(subject).alias("subject"), F.lit(hemi).alias("hemi"), vid.alias("vid"), (vid % width).alias("ix"), F.expr(f"id div {width}").alias("iy"),
        (vid % width).cast("double").alias("x"), F.expr(f"id div {width}").cast("double").alias("y"), F.lit(0.0).alias("z"),
        (vid % width).cast("double").alias("u"), F.expr(f"id div {width}").cast("double").alias("v"), F.lit(0.0).alias("value"),
    )
    return Mesh(points, grid_faces(points.select("subject", "hemi", "vid", "ix", "iy"), width), width)


def half_sphere(spark: SparkSession, n: int, radius: float = 50.0, subject: str = "sphere", hemi: str = "lh") -> Mesh:
    """A pole and n rings of n vertices: 1 + n * n vertices, n + 2 * n * (n - 1) faces; rings close on themselves."""
    key = [F.lit(subject).alias("subject"), F.lit(hemi).alias("hemi")]
    ring, k = F.expr(f"(id - 1) div {n} + 1"), F.expr(f"(id - 1) % {n}")
    phi, theta = F.when(F.col("id") == 0, 0.0).otherwise(ring * (3.141592653589793 / 2 / n)), F.when(F.col("id") == 0, 0.0).otherwise(k * (2 * 3.141592653589793 / n))
    points = spark.range(1 + n * n).select(
        *key, F.col("id").alias("vid"), F.when(F.col("id") == 0, 0).otherwise(k).cast("long").alias("ix"), F.when(F.col("id") == 0, 0).otherwise(ring).cast("long").alias("iy"),
        (radius * F.sin(phi) * F.cos(theta)).alias("x"), (radius * F.sin(phi) * F.sin(theta)).alias("y"), (radius * F.cos(phi)).alias("z"),
    ).withColumns({"u": F.col("x"), "v": F.col("y"), "value": F.lit(0.0)})
    spot = spark.range(n * n).select(F.expr(f"id div {n}").alias("r"), F.expr(f"id % {n}").alias("k"))
    here, right = 1 + F.col("r") * n + F.col("k"), 1 + F.col("r") * n + (F.col("k") + 1) % n
    cap = F.array(F.struct(F.lit(0).cast("long").alias("a"), here.alias("b"), right.alias("c")))
    band = F.array(F.struct((here - n).alias("a"), here.alias("b"), right.alias("c")), F.struct((here - n).alias("a"), right.alias("b"), (right - n).alias("c")))
    faces = spot.select("r", "k", F.explode(F.when(F.col("r") == 0, cap).otherwise(band)).alias("t"))
    return Mesh(points, faces.select(*key, (F.monotonically_increasing_id()).alias("fid"), "t.a", "t.b", "t.c"), n)
