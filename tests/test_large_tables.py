"""Tables of many rows in small files: no join sends them through the driver."""

import pytest
from pyspark.sql import functions as F

from meshql.operators import checkpoints, energy, mesh, metrics, topology
from meshql.plans import meshgen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """More customers than a join may send, in a file of well under 10 MB."""
    folder = str(tmp_path_factory.mktemp("many"))
    rows = spark.range(checkpoints.BROADCAST_ROWS + 20_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), (F.col("id") % 997).cast("double").alias("c_acctbal"))
    rows.coalesce(2).write.parquet(f"{folder}/customer.parquet")
    return folder


def test_vertices_of_a_large_mesh_are_not_broadcast(spark, customers):
    m = meshgen.table_mesh(spark, customers, "customer")
    adj, normals = mesh.mesh_graph(m.faces, m.vertices), metrics.vertex_normals(m.faces, m.vertices)
    for df in (adj, normals, metrics.surface_area(m.faces, m.vertices), mesh.faces_without(m.faces, m.wall), topology.inner_border(adj, m.wall)):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    # one row for each mesh is sent still
    assert "Broadcast" in plan(energy.initial_projection(m.vertices, normals))


def test_kept_tables_of_many_rows_are_not_broadcast(spark):
    """Many meshes' vertices fit a file of a few bytes a row, and are no less rows for that."""
    rows = spark.range(checkpoints.BROADCAST_ROWS + 20_000).select(F.format_string("s%06d", F.floor(F.col("id") / 512)).alias("subject"), F.lit("lh").alias("hemi"), (F.col("id") % 256).alias("vid"))
    many, few = checkpoints.kept(rows), checkpoints.kept(rows.where("subject < 's000010'"))
    faces = many.select("subject", "hemi", "vid", F.col("vid").alias("a"), F.col("vid").alias("b"), F.col("vid").alias("c"))
    assert "SortMergeJoin" in plan(mesh.faces_within(faces, many)) and "BroadcastHashJoin" not in plan(mesh.faces_within(faces, many))
    assert "BroadcastHashJoin" not in plan(few.join(mesh.used_vertices(faces.withColumn("fid", F.col("vid"))), ["subject", "hemi", "vid"]))
    assert "BroadcastHashJoin" in plan(rows.join(few, ["subject", "hemi", "vid"], "left_semi"))


def test_a_task_contracts_a_bounded_range(spark, monkeypatch):
    m, files, table = meshgen.plain_grid(spark, 40), [], topology.kept
    monkeypatch.setattr(topology, "RANGE", 100, raising=False)
    monkeypatch.setattr(topology, "kept", lambda df: files.append(len((out := table(df)).inputFiles())) or out)
    edges = mesh.edges(m.faces).select("subject", "hemi", "u", "v")
    parts = topology.components_by_ranges(edges.where("u % 40 <> 9 and v % 40 <> 9"), m.vertices.where("vid % 40 <> 9"))
    assert {(r["comp"], r["count"]) for r in parts.groupBy("comp").count().collect()} == {(0, 360), (10, 1200)}
    assert files[0] >= 12  # a file for each task
