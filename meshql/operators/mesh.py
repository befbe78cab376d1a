"""Mesh construction, projection and filtering. Tables carry subject and hemi; vertices are (vid, coordinates), faces (fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import distance, vec
from ..schema import KEY
from .checkpoints import settled

CORNERS = ("a", "b", "c")


#: Up to so many meshes a table with a row for each is broadcast, some 100 bytes a row.
BROADCAST_MESHES = 100_000


def each(rows: DataFrame, meshes: int | None) -> DataFrame:
    """A side with one row for each mesh, to be joined with their vertices or faces: sent to all tasks while the meshes are few; joined by shuffle, where a mesh is a small share, beyond.

    meshes: their number where it may be large; None stands for a few meshes.
    """
    return F.broadcast(rows) if meshes is None or meshes <= BROADCAST_MESHES else rows


def corners(faces: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Faces with the named point columns of each corner, suffixed 0, 1, 2 (equi-join of faces with points, once per corner)."""
    out = faces
    for i, c in enumerate(CORNERS):
        side = points.select(*KEY, F.col("vid").alias(c), *[F.col(p).alias(f"{p}{i}") for p in columns])
        out = out.join(side, [*KEY, c])
    return out


def face_vertices(faces: DataFrame) -> DataFrame:
    """(fid, vid) of every corner: one explode instead of a union of three projections."""
    return faces.select(*KEY, "fid", F.explode(F.array(*CORNERS)).alias("vid"))


def directed_edges(faces: DataFrame) -> DataFrame:
    pair = [F.struct(F.col(s).alias("s"), F.col(t).alias("t")) for s, t in (("a", "b"), ("b", "c"), ("c", "a"))]
    return faces.select(*KEY, "fid", F.explode(F.array(*pair)).alias("e")).select(*KEY, "fid", "e.s", "e.t")


def edges(faces: DataFrame) -> DataFrame:
    """Distinct undirected edges u < v and the number of faces at each."""
    return directed_edges(faces).groupBy(*KEY, F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).agg(F.count("*").alias("n_faces"))


def later_neighbours(faces: DataFrame) -> DataFrame:
    """(src, near): every vertex with the neighbours of larger ids, each once. All distinct edges, in fewer rows than edges() has."""
    ends = F.array(*[F.struct(F.least(s, t).alias("s"), F.greatest(s, t).alias("t")) for s, t in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select(*KEY, F.explode(ends).alias("e")).groupBy(*KEY, F.col("e.s").alias("src")).agg(F.collect_set("e.t").alias("near"))


def neighbour_pairs(faces: DataFrame) -> DataFrame:
    """(src, dst): both directions of every edge, without lengths."""
    edges = later_neighbours(faces).select(*KEY, "src", F.explode("near").alias("dst"))
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(*KEY, F.explode(both).alias("e")).select(*KEY, "e.src", "e.dst")


def edge_lengths(edge_table: DataFrame, vertices: DataFrame, name: str = "len") -> DataFrame:
    """Edges with the Euclidean distance of their ends."""
    ends = edge_table
    for c, i in (("u", 0), ("v", 1)):
        ends = ends.join(vertices.select(*KEY, F.col("vid").alias(c), *[F.col(a).alias(f"{a}{i}") for a in "xyz"]), [*KEY, c])
    return ends.select(*edge_table.columns, distance(vec("0"), vec("1")).alias(name))


def adjacency(lengths: DataFrame) -> DataFrame:
    """Both directions of every edge: src, dst, w."""
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return lengths.select(*KEY, F.explode(both).alias("e"), F.col("len").alias("w")).select(*KEY, "e.src", "e.dst", "w")


def mesh_graph(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Weighted symmetric adjacency of a mesh."""
    return adjacency(edge_lengths(edges(faces), vertices))


def induced(adj: DataFrame, members: DataFrame) -> DataFrame:
    """Adjacency between members alone."""
    for c in ("src", "dst"):
        adj = adj.join(members.select(*KEY, F.col("vid").alias(c)), [*KEY, c], "left_semi")
    return adj.select(*KEY, "src", "dst", "w")


def faces_within(faces: DataFrame, members: DataFrame) -> DataFrame:
    """Faces with all corners among members."""
    out = faces
    for c in CORNERS:
        out = out.join(members.select(*KEY, F.col("vid").alias(c)), [*KEY, c], "left_semi")
    return out.select(*faces.columns)


def faces_without(faces: DataFrame, excluded: DataFrame) -> DataFrame:
    """Faces with no corner among excluded."""
    out = faces
    for c in CORNERS:
        out = out.join(excluded.select(*KEY, F.col("vid").alias(c)), [*KEY, c], "left_anti")
    return out.select(*faces.columns)


def faces_touching(faces: DataFrame, members: DataFrame) -> DataFrame:
    """Faces with any corner among members."""
    hit = face_vertices(faces).join(members.select(*KEY, "vid"), [*KEY, "vid"], "left_semi").select(*KEY, "fid").distinct()
    return faces.join(hit, [*KEY, "fid"], "left_semi")


def used_vertices(faces: DataFrame) -> DataFrame:
    return face_vertices(faces).select(*KEY, "vid").distinct()


def removed_vertices(full: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices of the full surface that no face uses."""
    return full.select(*KEY, "vid").join(used_vertices(faces), [*KEY, "vid"], "left_anti")


#: Rows of a mesh that one task numbers, about.
NUMBERED = 200_000


def ranges(rows: DataFrame, order: str) -> DataFrame:
    """rows with _part: runs of an integer column's values, counted from 0 in each mesh. Numbers that lie close together, as ids and steps do, make runs of about NUMBERED rows."""
    span = settled(rows.groupBy(*KEY).agg(F.min(order).alias("_low"), F.ceil((F.max(order) - F.min(order) + 1) * (NUMBERED / F.count("*"))).alias("_width")))
    return rows.join(each(span, span.count()), KEY).withColumn("_part", F.floor((F.col(order) - F.col("_low")) / F.col("_width"))).drop("_low", "_width")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """A dense number from 0 in the order of an integer column, within each mesh. A mesh is numbered by runs, so that no task sorts it whole; rows are read three times and should be settled."""
    cut = ranges(rows, order)
    sums = cut.groupBy(*KEY, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = settled(sums.select(*KEY, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    place = F.row_number().over(Window.partitionBy(*KEY, "_part").orderBy(order)) - 1
    return cut.withColumn("_r", place).join(first, [*KEY, "_part"]).withColumn(name, (F.col("_first") + F.col("_r")).cast("long")).drop("_part", "_first", "_r")


def reindex(vertices: DataFrame) -> DataFrame:
    """Dense pid from 0 in the order of vid, within each mesh."""
    order = Window.partitionBy(*KEY).orderBy("vid")
    return vertices.withColumn("pid", (F.row_number().over(order) - 1).cast("long"))


def build_patch(vertices: DataFrame, faces: DataFrame, excluded: DataFrame) -> DataFrame:
    """The patch left by excluding vertices: pid, vid, x, y, z, is_border.

    A face with an excluded corner is dropped; the patch has the vertices of the other faces; its border are those of
    them that a dropped face had. The rim of an open mesh isn't border by itself. Vertices of no surviving face vanish.
    """
    kept = faces_without(faces, excluded)
    dropped = faces.join(kept.select(*KEY, "fid"), [*KEY, "fid"], "left_anti")
    rim = used_vertices(dropped).withColumn("_rim", F.lit(True))
    inside = used_vertices(kept).join(rim, [*KEY, "vid"], "left").select(*KEY, "vid", F.coalesce("_rim", F.lit(False)).alias("is_border"))
    return numbered(settled(inside.join(vertices, [*KEY, "vid"])), "vid", "pid").select(*KEY, "pid", "vid", "x", "y", "z", "is_border")


def patch_faces(faces: DataFrame, patch: DataFrame) -> DataFrame:
    """Faces among the patch's vertices, in its own ids; the joins filter and renumber at once."""
    out, patch = faces, settled(patch.select(*KEY, "vid", "pid"))
    for c in CORNERS:
        out = out.join(patch.select(*KEY, F.col("vid").alias(c), F.col("pid").alias(f"p_{c}")), [*KEY, c])
    return out.select(*KEY, "fid", *[F.col(f"p_{c}").alias(c) for c in CORNERS])


def drop_isolated(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that faces use, numbered anew, and the faces in the new ids."""
    used = reindex(vertices.join(used_vertices(faces), [*KEY, "vid"], "left_semi"))
    renamed = used.drop("vid").withColumnRenamed("pid", "vid")
    return renamed.select(*vertices.columns), patch_faces(faces, used)


def mean_surface(first: DataFrame, second: DataFrame) -> DataFrame:
    """The surface halfway between two surfaces of the same vertices."""
    other = second.select(*KEY, "vid", *[F.col(a).alias(f"{a}_") for a in "xyz"])
    return first.join(other, [*KEY, "vid"]).select(*KEY, "vid", *[((F.col(a) + F.col(f"{a}_")) / 2).alias(a) for a in "xyz"])


def degrees(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """vid, degree; 0 for vertices without edges."""
    n = adj.groupBy(*KEY, F.col("src").alias("vid")).agg(F.count("*").alias("degree"))
    return vertices.select(*KEY, "vid").join(n, [*KEY, "vid"], "left").select(*KEY, "vid", F.coalesce("degree", F.lit(0)).alias("degree"))
