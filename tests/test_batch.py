"""Many hemispheres at once: checks, faults that stay with their mesh, folders of files, content marks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshql import cli, folders
from meshql.config import FlattenConfig, Phase
from meshql.kernels import descent
from meshql.operators import batch, flatten, report
from meshql.plans import batches, population
from meshql.schema import SCHEMAS
from meshql.sources import binary

from . import oracle

VERTICES = "subject string, hemi string, vid long, x double, y double, z double"


def short():
    config = FlattenConfig()
    config.kring.k_ring, config.kring.n_neighbors_per_ring = 2, None
    config.phases = [Phase("short", 1.0, 1.0, [1, 0], 3)]
    config.negative_area_removal.enabled = config.final_negative_area_removal.enabled = False
    return config


def grid(width, height=None):
    height = height or width
    v = np.array([(x + 0.1 * ((x * 7 + y) % 3), y, 0.1 * ((x * y) % 5)) for y in range(height) for x in range(width)], dtype=float)
    f = [t for y in range(height - 1) for x in range(width - 1) for i in [y * width + x] for t in ((i, i + 1, i + width), (i + 1, i + width + 1, i + width))]
    return v, np.array(f)


def tables(spark, meshes):
    """meshes: {(subject, hemi): (vertices, faces)}"""
    v = [(*k, i, *map(float, p)) for k, (points, _) in meshes.items() for i, p in enumerate(points)]
    f = [(*k, i, *map(int, t)) for k, (_, faces) in meshes.items() for i, t in enumerate(faces)]
    return spark.createDataFrame(v, VERTICES), spark.createDataFrame(f, SCHEMAS["faces"])


def faulty():
    v, f = grid(6)
    nan = v.copy()
    nan[7, 1] = float("nan")
    flat = v * 0
    return {
        ("a", "lh"): (v, f), ("a", "rh"): (v, np.delete(f, [24, 25], axis=0)), ("b", "lh"): (v, np.vstack([f, [0, 1, 99]])), ("b", "rh"): (nan, f), ("c", "lh"): (flat, f),
        ("c", "rh"): (v, np.vstack([f, [1, 6, 20]])), ("d", "lh"): (v, f[:0]), ("d", "rh"): grid(6, 5),
    }


def test_checks_name_the_first_fault(spark):
    found = {(r["subject"], r["hemi"]): r for r in batch.validate(*tables(spark, faulty())).collect()}
    assert {k: r["error"] for k, r in found.items()} == {
        ("a", "lh"): None, ("a", "rh"): "Euler characteristic 0, not 1", ("b", "lh"): "1 corners are no vertex", ("b", "rh"): "1 vertices have no finite place",
        ("c", "lh"): "no area", ("c", "rh"): "an edge has 3 faces", ("d", "lh"): "no faces", ("d", "rh"): None,
    }
    assert found["a", "lh"]["n_vertices"] == 36 and found["a", "lh"]["n_edges"] == 85 and found["b", "lh"]["n_missing"] == 1
    twice = spark.createDataFrame([("a", "lh", i, float(i % 2), float(i // 2), 0.0) for i in (0, 1, 2, 2)], VERTICES)
    assert batch.validate(twice, spark.createDataFrame([("a", "lh", 0, 0, 1, 2)], SCHEMAS["faces"])).first()["error"] == "1 vertices occur twice"
    none = spark.createDataFrame([], VERTICES), spark.createDataFrame([], SCHEMAS["faces"])
    assert batch.validate(*none).count() == 0 and batch.flatten_batch(*none, short()).status.count() == 0


def test_a_fault_stays_with_its_mesh(spark, monkeypatch):
    class Fragile:
        name = "fragile"

        def is_available(self):
            return True

        def run(self, problem, uv, config):
            for i, s in enumerate(descent.flatten(problem, uv, config)):
                if problem.n == 30 and i == 2:
                    raise ZeroDivisionError("in the middle")
                yield s

    monkeypatch.setitem(flatten.BACKENDS, "fragile", Fragile())
    v, f = tables(spark, faulty() | {("e", "lh"): grid(7)})
    found = batch.flatten_batch(v, f, short(), "fragile")
    rows = {(r["subject"], r["hemi"]): r for r in found.status.collect()}
    assert len(rows) == 9 and {k for k, r in rows.items() if r["status"] == "done"} == {("a", "lh"), ("e", "lh")}
    assert rows["d", "rh"]["error"] == "ZeroDivisionError: in the middle" and rows["a", "rh"]["error"].startswith("Euler")
    assert rows["a", "lh"]["pct_error"] > 0 and rows["a", "lh"]["steps"] > 0
    assert found.uv.groupBy("subject", "hemi").count().count() == 2 and found.uv.count() == 36 + 49
    # the others' results are those of a mesh that runs alone
    alone = flatten.Flattener(short()).load(*(df.where("subject = 'e'") for df in (v, f))).compute_distances()
    alone.run()
    want = {r["vid"]: (r["u"], r["v"]) for r in alone.result().collect()}
    got = {r["vid"]: (r["u"], r["v"]) for r in found.uv.where("subject = 'e'").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    # done meshes aren't run again
    again = batch.flatten_batch(v, f, short(), done=found.status.where("status = 'done'"))
    assert {(r["subject"], r["hemi"]): r["status"] for r in again.status.collect()} == {k: "done" if k == ("d", "rh") else "error" for k in rows if k not in (("a", "lh"), ("e", "lh"))}


def test_every_mesh_is_dealt_out(spark):
    v, f = tables(spark, {(f"s{i}", "lh"): grid(4) for i in range(9)})
    runs = batch.attempts(v, f, flatten.ring_distances(v, f, short()), short())
    assert "REPARTITION_BY_NUM" in runs._jdf.queryExecution().executedPlan().toString() and runs.count() == 9


def test_content_marks(spark):
    v, f = tables(spark, {("a", "lh"): grid(3), ("a", "rh"): grid(3), ("b", "lh"): grid(3, 4)})
    marks = {(r["subject"], r["hemi"]): r["fingerprint"] for r in batch.fingerprints(v.repartition(3), f.orderBy(F.rand(1))).collect()}
    assert marks == {(r["subject"], r["hemi"]): r["fingerprint"] for r in batch.fingerprints(v, f).collect()}
    assert marks["a", "lh"] == marks["a", "rh"] != marks["b", "lh"]
    moved = v.withColumn("z", F.when((F.col("vid") == 2) & (F.col("hemi") == "rh"), 9.0).otherwise(F.col("z")))
    changed = {(r["subject"], r["hemi"]): r["fingerprint"] for r in batch.fingerprints(moved, f).collect()}
    assert {k for k in marks if marks[k] != changed[k]} == {("a", "rh")}


def test_limits_of_complete_subjects(spark):
    rows = [("a", "lh", 0, 0.0, 0.0), ("a", "lh", 1, 4.0, 1.0), ("a", "rh", 0, 0.0, 0.0), ("a", "rh", 1, 2.0, 6.0), ("b", "lh", 0, 0.0, 0.0), ("b", "lh", 1, 90.0, 1.0), ("c", "lh", 0, 1.0, 1.0), ("c", "rh", 0, 1.0, 3.0), ("c", "rh", 1, 9.0, 3.0)]
    found = {(r["subject"], r["hemi"]): (r["half"], r["own_limit"], r["shared_limit"]) for r in report.grid_limits(spark.createDataFrame(rows, "subject string, hemi string, vid long, u double, v double")).collect()}
    assert found == {("a", "lh"): (2.0, 3.0, 4.0), ("a", "rh"): (3.0, 3.0, 4.0), ("c", "lh"): (0.0, 4.0, 4.0), ("c", "rh"): (4.0, 4.0, 4.0)}


def folder_of_subjects(path):
    v, f = grid(8)
    keep = [i for i in range(64) if i not in (0, 9)]

    def put(subject, hemi, *, base="fiducial", raw=None, ids=keep):
        surf = path / subject / "surf"
        surf.mkdir(parents=True, exist_ok=True)
        if base:
            (surf / f"{hemi}.{base}").write_bytes(binary.write_surface(v, f))
        (surf / f"{hemi}.cut.patch.3d").write_bytes(binary.write_patch(v[ids], np.array(ids)) if raw is None else raw)

    put("one", "lh")
    put("one", "rh", base="smoothwm")
    put("two", "lh", base=None)
    put("two", "rh", raw=b"no patch at all")
    put("three", "lh", ids=[i for i in range(64) if i not in (27, 28, 35, 36)])  # a hole
    put("three", "rh")


def test_folder_in_one_job(spark, tmp_path, capsys):
    folder_of_subjects(tmp_path / "in")
    found = {(r["subject"], r["hemi"]): r for r in folders.flatten_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), short(), False).collect()}
    assert {k: r["status"] for k, r in found.items()} == {("one", "lh"): "done", ("one", "rh"): "done", ("two", "lh"): "error", ("two", "rh"): "error", ("three", "lh"): "error", ("three", "rh"): "done"}
    assert found["two", "lh"]["error"] == "no base surface" and found["two", "rh"]["error"].startswith("rh.cut.patch.3d: ") and "Euler" in found["three", "lh"]["error"]
    xyz, ids, _ = binary.read_patch((tmp_path / "out" / "one" / "lh.flat.patch.3d").read_bytes())
    assert len(ids) == found["one", "lh"]["n_used"] and (xyz[:, 2] == 0).all() and np.ptp(xyz[:, 0]) > 3
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.3d")}
    again = {(r["subject"], r["hemi"]): r["status"] for r in folders.flatten_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), short(), False).collect()}
    assert again == {k: "skipped" if r["status"] == "done" else "error" for k, r in found.items()} and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.3d")}
    cli_args = ["batch", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--k-ring", "2", "--n-neighbors", "0", "--short"]
    assert cli.main(cli_args) == 1
    said = capsys.readouterr().out
    assert "one lh: skipped" in said and "two lh: error: no base surface" in said


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(batches.QUERIES))
def test_same_rows(spark, name):
    oracle.same(spark, batches.QUERIES[name], batches.ORACLE_SQL[name], oracle.connection())


def test_keys_that_are_missing_show(spark):
    orders = spark.range(700).where("id <> 130").selectExpr("id as o_orderkey", "id * 13 % 50 as o_custkey", "1000.0 + id as o_totalprice")
    m = population.hemispheres(orders)
    found = {(r["subject"], r["hemi"]): r["error"] for r in batch.validate(m.vertices, m.faces).collect()}
    assert found == {("s000000", "lh"): "1 corners are no vertex", ("s000000", "rh"): None, ("s000001", "lh"): None}
    assert m.points.count() == 699


def test_many_meshes_are_not_broadcast(spark, monkeypatch):
    from meshql.operators import mesh

    v, f = tables(spark, {("a", "lh"): grid(5), ("b", "rh"): grid(4)})
    config, want = short(), None
    for most in (10, 1):
        monkeypatch.setattr(mesh, "BROADCAST_MESHES", most)
        places = flatten.initial(v, f, config, meshes=2)
        assert ("ResolvedHint (strategy=broadcast)" in places._jdf.queryExecution().analyzed().toString()) == (most == 10)
        got = sorted(map(tuple, places.collect()))
        assert want is None or np.allclose([r[2:] for r in got], [r[2:] for r in want])
        want = got
