"""Edges, boundaries, components, Euler characteristic, holes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import graph
from ..schema import KEY
from . import mesh
from .checkpoints import kept, settled


class TopologyError(ValueError):
    """A mesh isn't of the shape that is asked for."""


def euler(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """n_vertices, n_edges, n_faces, chi of each mesh."""
    v = vertices.groupBy(*KEY).agg(F.count("*").alias("n_vertices"))
    e = mesh.edges(faces).groupBy(*KEY).agg(F.count("*").alias("n_edges"))
    f = faces.groupBy(*KEY).agg(F.count("*").alias("n_faces"))
    return v.join(e, KEY, "left").join(f, KEY, "left").na.fill(0).withColumn("chi", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def check_disk(vertices: DataFrame, faces: DataFrame, *, strict: bool = True) -> DataFrame:
    """Meshes whose Euler characteristic isn't 1; raises if there are any and strict is set."""
    bad = euler(vertices, faces).where("chi <> 1")
    if strict and (first := bad.first()):
        raise TopologyError(f"{first['subject']}/{first['hemi']}: Euler characteristic {first['chi']}, not 1")
    return bad


def boundary_edges(faces: DataFrame) -> DataFrame:
    return mesh.edges(faces).where("n_faces = 1").select(*KEY, "u", "v")


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return boundary_edges(faces).select(*KEY, F.explode(F.array("u", "v")).alias("vid")).distinct()


def components(edge_table: DataFrame, vertices: DataFrame) -> DataFrame:
    """vid, comp: the smallest vid reachable along edges (u, v). Joins alone: labels move over edges and jump along labels, in a number of rounds that grows with the logarithm of the way."""
    both = settled(edge_table.select(*KEY, F.explode(F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("t")), F.struct(F.col("v").alias("s"), F.col("u").alias("t")))).alias("e")).select(*KEY, "e.s", "e.t").distinct())
    labels = kept(vertices.select(*KEY, "vid", F.col("vid").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("vid", "t"), [*KEY, "t"]).groupBy(*KEY, F.col("s").alias("vid")).agg(F.min("comp").alias("m"))
        moved = labels.join(near, [*KEY, "vid"], "left").select(*KEY, "vid", F.least("comp", "m").alias("to"), F.col("comp").alias("old"))
        jump = labels.select(*KEY, F.col("vid").alias("to"), F.col("comp").alias("far"))
        fresh = kept(moved.join(jump, [*KEY, "to"]).select(*KEY, "vid", F.least("to", "far").alias("comp"), "old"))
        labels = fresh.select(*KEY, "vid", "comp")
        if fresh.where("comp <> old").isEmpty():
            return labels


#: Vertices of a range that one task contracts, about, with all of their edges in memory.
RANGE = 100_000


def components_by_ranges(edge_table: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same as components() for large meshes whose near vertices have near ids. A range of vertices is contracted by one task; components() joins what is left, an edge for each two parts that meet.

    Ranges are dealt out by the number of vertices, which are counted for it: left to itself, the planner joins ranges up to a size of packed bytes that is many times as much in a task. An edge should be there one way.
    """
    ends = F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("t")), F.struct(F.col("v").alias("s"), F.col("u").alias("t")))
    both = edge_table.select(*KEY, F.explode(ends).alias("e")).select(*KEY, "e.s", "e.t")
    both = both.repartitionByRange(max(-(-vertices.count() // RANGE), edge_table.sparkSession.sparkContext.defaultParallelism), *KEY, "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        kinds = pc.dictionary_encode(pc.binary_join_element_wise(table["subject"], table["hemi"], "\0")).combine_chunks()
        code, s, t = kinds.indices.to_numpy().astype(np.int64), table["s"].to_numpy(), table["t"].to_numpy()
        del table, got
        names = [k.split("\0") for k in kinds.dictionary.to_pylist()]
        order = np.lexsort((s, code))
        new = np.ones(len(s), dtype=bool)
        new[1:] = (np.diff(s[order]) != 0) | (np.diff(code[order]) != 0)
        own, of = s[order][new], code[order][new]
        place = np.empty(len(s), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        # an edge's other end is this task's own if it is one of the mesh's vertices here
        ids, rank = np.unique(np.concatenate([own, t]), return_inverse=True)
        held, wanted = of * len(ids) + rank[: len(own)], code * np.int64(len(ids)) + rank[len(own) :]
        far = np.minimum(np.searchsorted(held, wanted), len(own) - 1)
        far = np.where(held[far] == wanted, far, -1)
        inner, root = far >= 0, np.arange(len(own))
        if inner.any():
            vid, low = graph.components(place[inner], far[inner])
            root[vid] = low
        label = own[root]
        out = np.flatnonzero(~inner)
        subject, hemi = (pa.array([n[i] for n in names]) for i in (0, 1))
        for c, v, to, comp in ((of, own, None, label), (code[out], s[out], t[out], label[place[out]])):
            whole = pa.table({"subject": subject.take(pa.array(c)), "hemi": hemi.take(pa.array(c)), "vid": pa.array(v), "t": pa.nulls(len(v), pa.int64()) if to is None else pa.array(to), "comp": pa.array(comp)})
            yield from whole.to_batches(max_chunksize=1 << 16)

    found = kept(both.mapInArrow(run, "subject string, hemi string, vid long, t long, comp long"))
    labels = found.where("t is null").select(*KEY, "vid", "comp")
    crossing = found.where("t is not null").select(*KEY, F.col("comp").alias("u"), "t").distinct()
    meet = kept(crossing.join(labels.withColumnsRenamed({"vid": "t", "comp": "v"}), [*KEY, "t"]).select(*KEY, "u", "v").where("u <> v").distinct())
    joined = components(meet, meet.select(*KEY, F.explode(F.array("u", "v")).alias("vid")).distinct()).select(*KEY, F.col("vid").alias("comp"), F.col("comp").alias("least"))
    own = vertices.select(*KEY, "vid").join(labels, [*KEY, "vid"], "left").withColumn("comp", F.coalesce("comp", "vid"))
    return own.join(joined, [*KEY, "comp"], "left").select(*KEY, "vid", F.coalesce("least", "comp").alias("comp"))


def components_by_mesh(edge_table: DataFrame, vertices: DataFrame) -> DataFrame:
    """The same as components() in one pass, for many bounded meshes side by side: one union-find per mesh."""
    ends = edge_table.select(*KEY, "u", "v").unionByName(vertices.select(*KEY, F.col("vid").alias("u"), F.col("vid").alias("v")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vid, comp = graph.components(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        return pd.DataFrame({"subject": pdf["subject"].iloc[0], "hemi": pdf["hemi"].iloc[0], "vid": vid, "comp": comp})

    return ends.groupBy(*KEY).applyInPandas(run, "subject string, hemi string, vid long, comp long")


def component_sizes(parts: DataFrame) -> DataFrame:
    """comp, size, rank: 1 for the largest, of equal ones that with the smallest vid first."""
    sizes = parts.groupBy(*KEY, "comp").agg(F.count("*").alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("size"), "comp")).cast("long"))


def drop_small_components(faces: DataFrame, vertices: DataFrame, *, small: int = 20, large: int = 100, strict: bool = True, label: Callable[[DataFrame, DataFrame], DataFrame] = components) -> DataFrame:
    """Vertices of the largest component, and of others with more than `small`; one with more than `large` is an error if strict. label: components or components_by_mesh."""
    parts = label(mesh.edges(faces), vertices)
    sizes = component_sizes(parts)
    if strict and (bad := sizes.where(f"rank > 1 and size > {large}").first()):
        raise TopologyError(f"{bad['subject']}/{bad['hemi']}: a second component has {bad['size']} vertices")
    return parts.join(sizes.where(f"rank = 1 or size > {small}"), [*KEY, "comp"], "left_semi").select(*KEY, "vid")


def boundary_loops(faces: DataFrame) -> DataFrame:
    """vid, loop: components of the boundary graph; loop is its smallest vid."""
    rim = boundary_edges(faces)
    return components(rim, boundary_vertices(faces)).withColumnRenamed("comp", "loop")


def boundary_paths(faces: DataFrame) -> DataFrame:
    """loop, ord, vid: each loop walked from its smallest vid to that one's smaller neighbour. A vertex with more than two boundary edges is walked as far as edges are left.

    Simple loops are ranked by joins; where loops cross or end, the walk depends on all steps before it and each connected part of the boundary is a group.
    """
    rim = settled(boundary_edges(faces))
    parts = components(rim, rim.select(*KEY, F.explode(F.array("u", "v")).alias("vid")).distinct())
    both = rim.select(*KEY, F.col("u").alias("s"), F.col("v").alias("t")).unionByName(rim.select(*KEY, F.col("v").alias("s"), F.col("u").alias("t")))
    both = settled(both.join(parts.withColumnRenamed("vid", "s"), [*KEY, "s"]))
    ends = both.groupBy(*KEY, "comp", "s").agg(F.count("*").alias("n"))
    crossed = ends.where("n <> 2").select(*KEY, "comp").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(loop[0], i, v) for loop in graph.loops(pdf["s"].tolist(), pdf["t"].tolist()) for i, v in enumerate(loop)]
        out = pd.DataFrame(rows, columns=["loop", "ord", "vid"])
        out.insert(0, "subject", pdf["subject"].iloc[0])
        out.insert(1, "hemi", pdf["hemi"].iloc[0])
        return out

    walked = both.where("s < t").join(crossed, [*KEY, "comp"], "left_semi").groupBy(*KEY, "comp").applyInPandas(run, "subject string, hemi string, loop long, ord int, vid long")
    return _ranked_loops(both.join(crossed, [*KEY, "comp"], "left_anti")).unionByName(walked)


def _ranked_loops(both: DataFrame) -> DataFrame:
    """loop, ord, vid of loops without crossings, given as edges (s, t) both ways with comp, the smallest vid. List ranking: the pointers of all steps double their reach in each round.

    A step (s, t) is followed by the step from t to its other neighbour. Steps that come back to the smallest vid are last; that from its larger neighbour ends the walk asked for.
    """
    ahead = both.select(*KEY, F.col("s").alias("t"), F.col("t").alias("w"))
    first = both.where("s = comp").groupBy(*KEY, "comp").agg(F.max("t").alias("before"))
    sizes = both.groupBy(*KEY, "comp").agg((F.count("*") / 2).cast("int").alias("size"))
    last = F.col("t") == F.col("comp")
    steps = both.join(ahead, [*KEY, "t"]).where("w <> s").select(*KEY, "comp", "s", "t", F.when(last, F.col("s")).otherwise(F.col("t")).alias("ps"), F.when(last, F.col("t")).otherwise(F.col("w")).alias("pt"), F.when(last, 0).otherwise(1).alias("n"))
    steps = kept(steps)
    while True:
        on = steps.select(*KEY, F.col("s").alias("ps"), F.col("t").alias("pt"), F.col("ps").alias("qs"), F.col("pt").alias("qt"), F.col("n").alias("more"))
        steps = kept(steps.join(on, [*KEY, "ps", "pt"]).select(*KEY, "comp", "s", "t", F.col("qs").alias("ps"), F.col("qt").alias("pt"), (F.col("n") + F.col("more")).alias("n")))
        if steps.where("pt <> comp").isEmpty():
            break
    walk = steps.join(first.withColumnRenamed("before", "ps"), [*KEY, "comp", "ps"], "left_semi").join(sizes, [*KEY, "comp"])
    return walk.select(*KEY, F.col("comp").alias("loop"), ((F.col("size") - F.col("n")) % F.col("size")).cast("int").alias("ord"), F.col("t").alias("vid"))


def longest_loop(faces: DataFrame) -> DataFrame:
    """Vertices of the longest boundary loop; of equally long ones that with the smallest vid."""
    loops = boundary_loops(faces)
    sizes = loops.groupBy(*KEY, "loop").agg(F.count("*").alias("size"))
    first = sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("size"), "loop"))).where("rank = 1")
    return loops.join(first, [*KEY, "loop"], "left_semi").select(*KEY, "vid")


def hole_fill_round(faces: DataFrame, excluded: DataFrame) -> DataFrame:
    """Vertices to exclude next so that the patch gets one simple boundary.

    Boundary vertices with more than two boundary neighbours if there are any; else those of all loops but the longest.
    """
    patch = mesh.faces_without(faces, excluded)
    rim = settled(boundary_edges(patch))
    ends = rim.select(*KEY, F.explode(F.array("u", "v")).alias("vid")).groupBy(*KEY, "vid").agg(F.count("*").alias("n"))
    knots = ends.where("n > 2").select(*KEY, "vid")
    loops = components(rim, ends.select(*KEY, "vid"))
    ranked = component_sizes(loops)
    others = loops.join(ranked.where("rank > 1"), [*KEY, "comp"], "left_semi").select(*KEY, "vid")
    return knots.unionByName(others.join(knots.select(*KEY).distinct(), KEY, "left_anti"))


def fill_holes(faces: DataFrame, excluded: DataFrame, rounds: int = 10) -> DataFrame:
    """All vertices that hole_fill_round adds until nothing is left to add, or for `rounds` rounds. One kernel per mesh."""
    tagged = faces.select(*KEY, "a", "b", "c").unionByName(excluded.select(*KEY, F.col("vid").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("c")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"].notna()][["a", "b", "c"]].to_numpy(dtype="int64")
        added = graph.fill_holes(own, set(pdf[pdf["b"].isna()]["a"].astype("int64")), rounds)
        return pd.DataFrame({"subject": pdf["subject"].iloc[0], "hemi": pdf["hemi"].iloc[0], "vid": sorted(added)}).astype({"vid": "int64"})

    return tagged.groupBy(*KEY).applyInPandas(run, "subject string, hemi string, vid long")


def inner_border(adj: DataFrame, members: DataFrame) -> DataFrame:
    """Members with a neighbour outside."""
    inside = members.select(*KEY, F.col("vid").alias("src"))
    out = adj.join(inside, [*KEY, "src"], "left_semi").join(members.select(*KEY, F.col("vid").alias("dst")), [*KEY, "dst"], "left_anti")
    return out.select(*KEY, F.col("src").alias("vid")).distinct()


def outer_border(adj: DataFrame, members: DataFrame) -> DataFrame:
    """Neighbours of members that are outside."""
    inside = members.select(*KEY, F.col("vid").alias("src"))
    out = adj.join(inside, [*KEY, "src"], "left_semi").join(members.select(*KEY, F.col("vid").alias("dst")), [*KEY, "dst"], "left_anti")
    return out.select(*KEY, F.col("dst").alias("vid")).distinct()


def wall_and_cuts(adj: DataFrame, removed: DataFrame, threshold: int = 2) -> DataFrame:
    """Split removed vertices: vid, part (0 the medial wall, cuts from 1 by size), comp.

    The wall is the largest component of vertices with more than `threshold` removed neighbours; all others form the cuts by component.
    """
    own = settled(mesh.induced(adj, removed))
    degree = mesh.degrees(own, removed)

    def parts(members: DataFrame) -> DataFrame:
        return components(mesh.induced(own, members).select(*KEY, F.col("src").alias("u"), F.col("dst").alias("v")), members)

    high = parts(degree.where(F.col("degree") > threshold).select(*KEY, "vid"))
    high = settled(high)
    wall = settled(high.join(component_sizes(high).where("rank = 1"), [*KEY, "comp"], "left_semi"))
    rest = settled(parts(removed.select(*KEY, "vid").join(wall, [*KEY, "vid"], "left_anti")))
    ranked = rest.join(component_sizes(rest), [*KEY, "comp"]).select(*KEY, "vid", F.col("rank").cast("int").alias("part"), "comp")
    return wall.select(*KEY, "vid", F.lit(0).alias("part"), "comp").unionByName(ranked)
