"""Cuts as tables: nearest sets, anchors, continuity, refinement, absorption. Kernels run once per mesh."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import distance, vec
from ..kernels import cuts as kernel
from ..kernels import graph
from ..schema import KEY
from . import mesh, packs, topology
from .checkpoints import kept, settled

CUTS = "subject string, hemi string, name string, vid long, ord int"


def _suffixed(points: DataFrame, suffix: str, *extra: str) -> DataFrame:
    return points.select(*KEY, F.col("vid").alias(f"vid{suffix}"), *[F.col(a).alias(f"{a}{suffix}") for a in "xyz"], *[F.col(e).alias(f"{e}{suffix}") for e in extra])


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of every point of a the nearest of b in the same mesh, of equally near ones the smaller vid: vid, near, distance.

    One kernel per mesh that works in blocks; no pairs are made as rows.
    """
    both = a.select(*KEY, "vid", "x", "y", "z", F.lit(0).alias("side")).unionByName(b.select(*KEY, "vid", "x", "y", "z", F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == s].sort_values("vid") for s in (0, 1)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"subject": [], "hemi": [], "vid": [], "near": [], "distance": []}).astype({"vid": "int64", "near": "int64", "distance": "float64"})
        points = [dict(zip(s["vid"], s[["x", "y", "z"]].to_numpy(), strict=True)) for s in sides]
        ids = [s["vid"].tolist() for s in sides]
        near, at = [], []
        for i in range(0, len(ids[0]), 2048):
            p = sides[0][["x", "y", "z"]].to_numpy()[i : i + 2048]
            q = sides[1][["x", "y", "z"]].to_numpy()
            d = np.full(len(p), np.inf)
            k = np.zeros(len(p), dtype=int)
            for j in range(0, len(q), 4096):
                e = np.sqrt(((p[:, None] - q[None, j : j + 4096]) ** 2).sum(axis=2))
                m = e.argmin(axis=1)
                v = e[np.arange(len(p)), m]
                k, d = np.where(v < d, m + j, k), np.minimum(d, v)
            near.append(d)
            at.append(k)
        return pd.DataFrame({"subject": pdf["subject"].iloc[0], "hemi": pdf["hemi"].iloc[0], "vid": ids[0], "near": np.array(ids[1])[np.concatenate(at)], "distance": np.concatenate(near)})

    return both.groupBy(*KEY).applyInPandas(run, "subject string, hemi string, vid long, near long, distance double")


def set_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Smallest distance between two vertex sets, and where: of equally near pairs that of the smallest ids."""
    best = F.min(F.struct("distance", "vid", "near"))
    return nearest(a, b).groupBy(*KEY).agg(best.alias("b")).select(*KEY, F.col("b.vid").alias("vid"), F.col("b.near").alias("near"), F.col("b.distance").alias("distance"))


def farthest_from(points: DataFrame, start: DataFrame) -> DataFrame:
    """The point farthest from each mesh's start point."""
    d = points.join(F.broadcast(_suffixed(start, "0")), KEY).withColumn("distance", distance(vec(""), vec("0")))
    best = d.groupBy(*KEY).agg(F.max(F.struct("distance", (-F.col("vid")).alias("v"))).alias("b"))
    return best.select(*KEY, (-F.col("b.v")).alias("vid"), F.col("b.distance").alias("distance"))


def farthest_pair(points: DataFrame) -> DataFrame:
    """The two points of each mesh that are farthest apart: p < q, distance. One kernel per mesh."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = dict(zip(pdf["vid"], pdf[["x", "y", "z"]].to_numpy(), strict=True))
        p, q, d = kernel.farthest_pair(own, list(own))
        return pd.DataFrame({"subject": [pdf["subject"].iloc[0]], "hemi": [pdf["hemi"].iloc[0]], "p": [min(p, q)], "q": [max(p, q)], "distance": [d]})

    return points.select(*KEY, "vid", "x", "y", "z").groupBy(*KEY).applyInPandas(run, "subject string, hemi string, p long, q long, distance double")


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Points of a with a point of b nearer than radius.

    A range join on cubes of that side: b is copied to the cubes around its own, so that only neighbours meet.
    """
    cube = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]
    left = a.select(*KEY, "vid", "x", "y", "z", *cube)
    right = _suffixed(b, "1").select("*", *[F.floor(F.col(f"{c}1") / radius).alias(f"h{c}") for c in "xyz"])
    for c in "xyz":
        right = right.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"h{c}") + i for i in (-1, 0, 1)])))
    return left.join(right, [*KEY, "cx", "cy", "cz"]).where(distance(vec(""), vec("1")) < radius).select(*KEY, "vid").distinct()


Work = Callable[[graph.Adjacency, kernel.Points, dict[str, list[int]], set[int]], dict[str, list[int]]]


def _on_meshes(adj: DataFrame, points: DataFrame | None, cuts: DataFrame | None, wall: DataFrame | None, work: Work) -> DataFrame:
    """work() once per mesh. Its group are the mesh's cuts and wall; edges and places are read from the packed mesh as far as the work goes."""
    text, real, none = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0).cast("long")
    packed = packs.packed(adj) if points is None else packs.packed(adj, points.select(*KEY, "vid", "x", "y", "z"), ("x", "y", "z"))
    rows = packed.where("block <= 0").select(*KEY, F.lit("m").alias("kind"), F.col("uri").alias("name"), F.col("at").alias("i"), F.col("size").alias("j"), "block")
    if cuts is not None:
        rows = rows.unionByName(cuts.select(*KEY, F.lit("c").alias("kind"), "name", F.col("vid").alias("i"), F.col("ord").cast("long").alias("j"), real.alias("block")))
    if wall is not None:
        rows = rows.unionByName(wall.select(*KEY, F.lit("w").alias("kind"), text.alias("name"), F.col("vid").alias("i"), none.alias("j"), real.alias("block")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds, empty = {k: g for k, g in pdf.groupby("kind")}, pdf.iloc[:0]
        near = {}
        for m in kinds.get("m", empty).itertuples():
            near = packs.WideMesh(m.name, int(m.i), int(m.j), int(m.block))
        own = {n: g.sort_values("j")["i"].tolist() for n, g in kinds.get("c", empty).groupby("name")}
        out = work(near, near, own, set(kinds.get("w", empty)["i"].tolist()))
        rows = [(pdf["subject"].iloc[0], pdf["hemi"].iloc[0], n, v, i) for n, c in sorted(out.items()) for i, v in enumerate(c)]
        return pd.DataFrame(rows, columns=["subject", "hemi", "name", "vid", "ord"]).astype({"vid": "int64", "ord": "int32"})

    return rows.groupBy(*KEY).applyInPandas(run, CUTS)


def continuous(adj: DataFrame, points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts whose parts are joined: nearest parts in the points' geometry, paths in the adjacency's. Names beyond the five anatomical ones pass through."""

    def work(near: graph.Adjacency, where: kernel.Points, own: dict[str, list[int]], _: set[int]) -> dict[str, list[int]]:
        return {n: sorted(kernel.continuous(near, where, set(c))) if n in kernel.CUT_NAMES else c for n, c in own.items()}

    return _on_meshes(adj, points, cuts, None, work)


def refine(adj: DataFrame, points: DataFrame, cuts: DataFrame, wall: DataFrame) -> DataFrame:
    """Cuts replaced by shortest paths to the wall, with what they trap, then parts cut off absorbed by the nearest cut."""

    def work(near: graph.Adjacency, where: kernel.Points, own: dict[str, list[int]], walls: set[int]) -> dict[str, list[int]]:
        return {n: kernel.refined(near, where, c, walls) if n in kernel.CUT_NAMES else c for n, c in own.items()}

    adj = settled(adj)
    return absorb(adj, points, settled(_on_meshes(adj, points, cuts, wall, work)), wall)


def absorb(adj: DataFrame, points: DataFrame, cuts: DataFrame, wall: DataFrame) -> DataFrame:
    """Parts of the patch other than the largest added to the nearest cut, with no vertex repeated removed.

    The parts are found by ranges and joins; a mesh's kernel sees its cuts and the parts that go to them, never the patch.
    """
    taken = cuts.select(*KEY, "vid").unionByName(wall.select(*KEY, "vid")).distinct()
    rest = kept(points.select(*KEY, "vid").join(taken, [*KEY, "vid"], "left_anti"))
    inside = mesh.induced(adj.where("src < dst"), rest).select(*KEY, F.col("src").alias("u"), F.col("dst").alias("v"))
    parts = kept(topology.components_by_ranges(inside, rest))
    ranked = settled(topology.component_sizes(parts))
    # the largest part, often all but the whole mesh, is left out before a join by part, where it would be one task's
    first = ranked.where("rank = 1").select(*KEY, F.col("comp").alias("_first"))
    others = parts.join(mesh.each(first, first.count()), KEY).where("comp <> _first").drop("_first")
    regions = others.join(ranked.where("rank > 1").select(*KEY, "comp", "rank"), [*KEY, "comp"]).select(*KEY, F.lit(None).cast("string").alias("name"), "vid", F.col("rank").alias("ord"))
    rows = cuts.select(*KEY, "name", "vid", F.col("ord").cast("long").alias("ord")).unionByName(regions)
    rows = rows.join(points.select(*KEY, "vid", "x", "y", "z"), [*KEY, "vid"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {n: g.sort_values("ord")["vid"].tolist() for n, g in pdf.groupby("name")}
        regions = [sorted(g["vid"].tolist()) for _, g in sorted(pdf[pdf["name"].isna()].groupby("ord"), key=lambda x: x[0])]
        where = dict(zip(pdf["vid"].tolist(), pdf[["x", "y", "z"]].to_numpy(), strict=True))
        out = kernel.absorbed(where, own, regions)
        rows = [(pdf["subject"].iloc[0], pdf["hemi"].iloc[0], n, v, i) for n, c in sorted(out.items()) for i, v in enumerate(c)]
        return pd.DataFrame(rows, columns=["subject", "hemi", "name", "vid", "ord"]).astype({"vid": "int64", "ord": "int32"})

    return rows.groupBy(*KEY).applyInPandas(run, CUTS)


def shortest_paths(adj: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst, ord, vid, length of the shortest path of each pair; pairs out of reach are left out. A group are the pairs of one source; the search reads the packed mesh as far as it goes."""
    rows = pairs.select(*KEY, "src", "dst").join(packs.packed(adj).where("block <= 0"), KEY, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, s, out = pdf.iloc[0], int(pdf["src"].iloc[0]), []
        near = packs.WideMesh(m["uri"], int(m["at"]), int(m["size"]), int(m["block"])) if isinstance(m["uri"], str) else {}
        for t, (d, walk) in sorted(graph.paths(near, s, set(pdf["dst"].tolist())).items()):
            out += [(m["subject"], m["hemi"], s, t, i, v, d) for i, v in enumerate(walk)]
        return pd.DataFrame(out, columns=["subject", "hemi", "src", "dst", "ord", "vid", "length"]).astype({"src": "int64", "dst": "int64", "ord": "int32", "vid": "int64", "length": "float64"})

    return rows.groupBy(*KEY, "src").applyInPandas(run, "subject string, hemi string, src long, dst long, ord int, vid long, length double")


def trapped(adj: DataFrame, points: DataFrame, excluded: DataFrame, anchor: int) -> DataFrame:
    """Vertices around the anchor that the excluded ones shut in."""

    def work(near: graph.Adjacency, _: kernel.Points, __: dict[str, list[int]], walls: set[int]) -> dict[str, list[int]]:
        return {"trapped": sorted(graph.trapped(near, walls, anchor))}

    return _on_meshes(adj, None, None, excluded, work).select(*KEY, "vid")


def map_by_nearest(cuts: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Cuts carried to another surface's nearest vertices: an approximation of a registration by an outside tool, which isn't claimed to be equal."""
    placed = source.join(cuts.select(*KEY, "vid").distinct(), [*KEY, "vid"], "left_semi")
    near = nearest(placed, target)
    return cuts.join(near.select(*KEY, "vid", "near"), [*KEY, "vid"]).groupBy(*KEY, "name", F.col("near").alias("vid")).agg(F.min("ord").alias("ord"))
