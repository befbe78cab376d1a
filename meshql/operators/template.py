"""Template derivation: removed vertices become a medial wall and up to five named cuts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import cuts as kernel
from ..schema import KEY
from .checkpoints import settled
from . import mesh, topology


def merge_small(parts: DataFrame, rim: DataFrame, points: DataFrame, keep: int = 5) -> DataFrame:
    """part 0 is the wall, 1.. the cuts by size; those beyond `keep` join the nearest main cut or the wall: vid, part."""
    rows = parts.select(*KEY, "vid", "part").unionByName(rim.select(*KEY, "vid", F.lit(-1).alias("part"))).join(points.select(*KEY, "vid", "x", "y", "z"), [*KEY, "vid"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, vid, xyz = table["part"].to_numpy(), table["vid"].to_numpy(), np.stack([table[c].to_numpy() for c in "xyz"], axis=1)
        order = np.flatnonzero(part > 0)
        order = order[np.lexsort((vid[order], part[order]))]
        component = np.unique(part[order], return_inverse=True)[1]
        to = kernel.nearest_mains(xyz[order], component, xyz[part == -1], keep)
        # mains count from 1; the wall is 0
        vid, out = np.concatenate([vid[part == 0], vid[order]]), np.concatenate([np.zeros((part == 0).sum(), dtype=np.int32), ((to + 1) % (keep + 1))[component].astype(np.int32)])
        return pa.table({c: pa.repeat(k, len(vid)) for c, k in zip(KEY, key, strict=True)} | {"vid": pa.array(vid), "part": pa.array(out)})

    return rows.groupBy(*KEY).applyInArrow(run, "subject string, hemi string, vid long, part int")


def wall_axes(wall: DataFrame) -> DataFrame:
    """Principal axes of the wall in the YZ plane: p1 (along Z, pointing up), p2 (along Y, pointing forward).

    Closed form of a 2 x 2 covariance; where it has no direction at all the axes are Z and Y.
    """
    c = wall.groupBy(*KEY).agg(F.var_pop("y").alias("a"), F.covar_pop("y", "z").alias("b"), F.var_pop("z").alias("d"))
    theta = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("d"))
    flat = (F.abs("b") < 1e-12) & (F.abs(F.col("a") - F.col("d")) < 1e-12)
    first_y, first_z = F.when(flat, 0.0).otherwise(F.cos(theta)), F.when(flat, 1.0).otherwise(F.sin(theta))
    axes = c.select(*KEY, first_y.alias("fy"), first_z.alias("fz"))
    upright = F.abs("fy") <= F.abs("fz")
    axes = axes.select(*KEY, F.when(upright, F.col("fy")).otherwise(-F.col("fz")).alias("y1"), F.when(upright, F.col("fz")).otherwise(F.col("fy")).alias("z1"), F.when(upright, -F.col("fz")).otherwise(F.col("fy")).alias("y2"), F.when(upright, F.col("fy")).otherwise(F.col("fz")).alias("z2"))
    s1, s2 = F.when(F.col("z1") < 0, -1.0).otherwise(1.0), F.when(F.col("y2") < 0, -1.0).otherwise(1.0)
    return axes.select(*KEY, (s1 * F.col("y1")).alias("p1_y"), (s1 * F.col("z1")).alias("p1_z"), (s2 * F.col("y2")).alias("p2_y"), (s2 * F.col("z2")).alias("p2_z"))


def name_cuts(parts: DataFrame, points: DataFrame, wall_points: DataFrame) -> DataFrame:
    """part, name, pc1, pc2: the lowest centroid along the first axis is temporal, the others by the second axis calcarine, medial1, medial2, medial3."""
    placed = parts.where("part > 0").join(points, [*KEY, "vid"]).join(F.broadcast(wall_axes(wall_points)), KEY)
    pc = placed.groupBy(*KEY, "part").agg(F.avg(F.col("y") * F.col("p1_y") + F.col("z") * F.col("p1_z")).alias("pc1"), F.avg(F.col("y") * F.col("p2_y") + F.col("z") * F.col("p2_z")).alias("pc2"))
    low = pc.withColumn("_low", F.row_number().over(Window.partitionBy(*KEY).orderBy("pc1", "part")) == 1)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("_low", "pc2", "part"))
    named = low.withColumn("_rank", rank)
    label = F.when(F.col("_low"), F.lit("temporal")).otherwise(F.element_at(F.array(*[F.lit(n) for n in kernel.CUT_NAMES[:4]]), F.least(F.col("_rank"), F.lit(4))))
    return named.where(F.col("_low") | (F.col("_rank") <= 4)).select(*KEY, "part", label.alias("name"), "pc1", "pc2")


def derive(full: DataFrame, full_faces: DataFrame, patch_faces: DataFrame) -> DataFrame:
    """cuts (name, vid) of a hemisphere: mwall and the named cuts, from the full surface and a patch cut from it. Vertex coordinates are those of full."""
    removed = settled(mesh.removed_vertices(full, patch_faces))
    adj = settled(mesh.mesh_graph(full_faces, full))
    parts = settled(topology.wall_and_cuts(adj, removed))
    rim = topology.inner_border(adj, parts.where("part = 0").select(*KEY, "vid"))
    merged = settled(merge_small(parts.select(*KEY, "vid", "part"), rim, full))
    wall = merged.where("part = 0").join(full, [*KEY, "vid"])
    names = name_cuts(merged, full, wall)
    named = merged.join(names.select(*KEY, "part", "name"), [*KEY, "part"], "left")
    return named.select(*KEY, F.when(F.col("part") == 0, "mwall").otherwise(F.col("name")).alias("name"), "vid").where("name is not null")
