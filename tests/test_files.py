"""File layouts, configuration, streaming and the command line."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshql import cli
from meshql.config import FlattenConfig, cache_name
from meshql.operators import mesh
from meshql.plans.meshgen import plain_grid
from meshql.schema import SCHEMAS
from meshql.sources import binary, files, store
from meshql.streaming import telemetry


def test_patch_bytes():
    r = np.random.default_rng(1)
    xyz, ids, border = r.standard_normal((7, 3)).astype(np.float32), np.array([5, 0, 9, 3, 2**31 - 2, 1, 8], dtype=np.uint32), np.array([1, 0, 1, 0, 1, 0, 0], dtype=bool)
    raw = binary.write_patch(xyz, ids, border)
    assert raw[:8] == struct.pack(">2i", -1, 7) and struct.unpack(">i", raw[8:12])[0] == -6 and struct.unpack(">i", raw[24:28])[0] == 1 and len(raw) == 8 + 7 * 16
    got = binary.read_patch(raw)
    assert np.array_equal(got[0], xyz) and got[1].tolist() == ids.tolist() and got[2].tolist() == border.tolist()
    assert (binary.read_patch(binary.write_patch(xyz[:, :2], ids))[0][:, 2] == 0).all()
    for bad in (b"", struct.pack(">2i", 1, 0), raw[:-1]):
        with pytest.raises(ValueError):
            binary.read_patch(bad)


def test_surface_and_curvature_bytes():
    v, f = np.arange(12, dtype=np.float32).reshape(4, 3), np.array([[0, 1, 2], [1, 3, 2]])
    got = binary.read_surface(binary.write_surface(v, f))
    assert np.array_equal(got[0], v) and np.array_equal(got[1], f)
    assert binary.read_curvature(binary.write_curvature(np.array([0.5, -1.0]))).tolist() == [0.5, -1.0]
    for read in (binary.read_surface, binary.read_curvature):
        with pytest.raises(ValueError):
            read(b"\0" * 20)


def test_files_round_trip(spark, tmp_path):
    grid = plain_grid(spark, 6)
    patch = mesh.build_patch(grid.vertices, grid.faces, grid.points.where("ix = 0").select("subject", "hemi", "vid"))
    done = files.write_patches(patch, str(tmp_path / "out")).collect()
    assert [(r["subject"], r["hemi"]) for r in done] == [("grid", "lh")] and done[0]["n_bytes"] == 8 + 16 * 30
    back = files.read_patches(spark, done[0]["path"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, patch.collect()))
    files.write_labels(grid.points.where("ix = 0"), grid.vertices, str(tmp_path / "labels"), "mwall").collect()
    label = files.read_labels(spark, str(tmp_path / "labels/grid/lh.mwall.label"))
    assert sorted(r["vid"] for r in label.collect()) == [0, 6, 12, 18, 24, 30] and label.first()["hemi"] == "lh"
    folder = tmp_path / "sub-1" / "surf"
    folder.mkdir(parents=True)
    (folder / "lh.fiducial").write_bytes(binary.write_surface(np.zeros((3, 3)), np.array([[0, 1, 2]])))
    (folder / "lh.curv").write_bytes(binary.write_curvature(np.array([1.0, 2.0, 3.0])))
    assert files.read_vertices(spark, str(folder / "lh.fiducial")).count() == 3 and tuple(files.read_faces(spark, str(folder / "lh.fiducial")).first()) == ("sub-1", "lh", 0, 0, 1, 2)
    curv = files.read_curvatures(spark, str(folder / "lh.curv"))
    assert [r["value"] for r in curv.orderBy("vid").collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(IndexError):
        files.curvature_of_patch(curv, patch.selectExpr("'sub-1' as subject", "hemi", "pid", "vid"))


def test_text_formats(spark):
    lines = spark.createDataFrame([("s", "lh", x) for x in ("#!ascii label", "3", "", "7 0 0 0 1.0", "  4  1 2 3 1.0 extra", "9 1 2", "x 0 0 0 1")], "subject string, hemi string, line string")
    assert sorted(r["vid"] for r in files.parse_labels(lines).collect()) == [4, 7]
    text = spark.createDataFrame([(json.dumps({"lh_mwall": [3, 1], "rh_mwall": [9], "lh_calcarine": []}),)], "value string")
    assert [tuple(r) for r in files.parse_template(text, "lh").orderBy("ord").collect()] == [("mwall", 3, 0), ("mwall", 1, 1)]
    log = "Input patch: /data/sub-01/lh.cut.patch.3d\n...\nFINAL RESULT\nFlipped triangles: 100 -> 5\nMean % distance error: 2.35%\n"
    rows = spark.createDataFrame([(log,), ("nothing",), ("Input patch: /d/sub-2/surf/rh.x\nFINAL RESULT\nFlipped triangles: 1",)], "value string")
    got = [tuple(r) for r in files.parse_logs(rows).collect()]
    assert got == [(2.35, 5, "sub-01", "lh"), (None, None, None, None), (None, None, "sub-2", "rh")]


def test_finding_files(spark, monkeypatch):
    paths = ["/d/s/surf/lh.white", "/d/s/surf/lh.smoothwm", "/d/s/surf/rh.fiducial"]
    assert files.base_surface(paths, "/d/s/surf/lh.cut.3d") == "/d/s/surf/lh.smoothwm" and files.base_surface(paths, "/d/s/surf/lh.cut.3d", files.REPORT_SURFACES) == "/d/s/surf/lh.white"
    assert files.base_surface(paths, "/d/s/surf/xx.3d") is None
    curv = ["/s/lh.curv", "/s/rh.curv"]
    assert files.detect_curvature(curv, "/s", "/x/rh.npz", {curv[1]: 9}, 5) == curv[1] and files.detect_curvature(curv, "/s", "x", {curv[0]: 3, curv[1]: 9}, 5) == curv[1]
    assert files.detect_curvature(curv, "/s", "lh.npz", {curv[0]: 3}, 5) is None
    found = spark.createDataFrame([(p,) for p in ("/d/s1/surf/lh.flat.patch.3d", "/d/s1/surf/rh.flat.patch.3d", "/d/s2/lh.flat.patch.3d")], "path string")
    assert [r["subject"] for r in files.complete_subjects(found).collect()] == ["s1"]
    monkeypatch.setenv("SUBJECTS_DIR", "/env")
    assert files.surface_path("s", "white", "lh", "/arg") == "/arg/s/surf/lh.white" and files.surface_path("s", "white", "lh") == "/env/s/surf/lh.white"
    monkeypatch.delenv("SUBJECTS_DIR")
    with pytest.raises(ValueError):
        files.surface_path("s", "white", "lh")


def test_config():
    c = FlattenConfig.from_json(FlattenConfig(initial_scale=2.0).to_json())
    assert c == FlattenConfig(initial_scale=2.0) and c.kring.k_ring == 7 and [p.name for p in c.phases] == ["epoch_1", "epoch_2", "epoch_3"]
    assert FlattenConfig.from_dict({"kring": {"k_ring": 3}}).kring.n_neighbors_per_ring == 12
    for bad in ({"unknown": 1}, {"kring": {"unknown": 1}}, {"phases": [{"unknown": 1}]}):
        with pytest.raises(TypeError):
            FlattenConfig.from_dict(bad)
    assert cache_name("o", "h", 7, None) == "o.kring_k7_nall_h"


def shots(spark):
    rows = [("s", "lh", i, "a" if i < 3 else "b", i, 9.0 - i, 1.0, 5 - i, [(0.0, 1.0)]) for i in range(1, 5)]
    return spark.createDataFrame(rows, "subject string, hemi string, step int, phase string, iteration int, j_d double, j_a double, n_flipped int, uv array<struct<u:double,v:double>>")


def test_snapshot_store_and_stream(spark, tmp_path):
    path = str(tmp_path / "shots")
    store.write_snapshots(shots(spark), path)
    assert store.read_snapshots(spark, path).count() == 4
    with pytest.raises(ValueError):
        store.write_snapshots(shots(spark).limit(0), path + "x")
    flat = str(tmp_path / "flat")
    shots(spark).write.parquet(flat)
    q = telemetry.watch(telemetry.follow(spark, flat), "progress", str(tmp_path / "state"))
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, telemetry.progress(shots(spark)).collect()))


def test_cache_by_content(spark, tmp_path):
    grid, calls = plain_grid(spark, 4), []
    h = store.mesh_hash(grid.vertices, grid.faces)
    assert h == store.mesh_hash(grid.vertices.orderBy("x"), grid.faces) != store.mesh_hash(grid.vertices.where("vid > 0"), grid.faces)

    def compute():
        calls.append(1)
        return grid.faces

    path = str(tmp_path / h)
    assert store.cached(spark, path, compute).count() == store.cached(spark, path, compute).count() == 18 and calls == [1]


def test_command_line(spark, tmp_path, capsys):
    grid = plain_grid(spark, 5)
    surf = tmp_path / "sub-9" / "surf"
    surf.mkdir(parents=True)
    v = np.array([(r["x"], r["y"], 0.2 * (r["vid"] % 3)) for r in grid.vertices.orderBy("vid").collect()])
    f = np.array([(r["a"], r["b"], r["c"]) for r in grid.faces.orderBy("fid").collect()])
    for name in ("fiducial", "inflated"):
        (surf / f"lh.{name}").write_bytes(binary.write_surface(v, f))
    (surf / "lh.cut.patch.3d").write_bytes(binary.write_patch(v, np.arange(25)))
    assert cli.main(["flatten", str(surf / "lh.cut.patch.3d"), "--k-ring", "2", "--n-neighbors", "0", "--short"]) == 0
    assert binary.read_patch((surf / "lh.flat.patch.3d").read_bytes())[1].tolist() == list(range(25))
    assert cli.main(["report", str(surf / "lh.flat.patch.3d")]) == 0 and "n_flipped" in capsys.readouterr().out
    assert cli.main(["report", str(surf / "lh.missing.3d"), "--base", "/no/such/file"]) == 1
    (tmp_path / "t.json").write_text(json.dumps({"lh_mwall": [12], "lh_calcarine": [10, 11], "rh_mwall": [1]}))
    assert cli.main([str(surf.parent), "--template", str(tmp_path / "t.json"), "--hemi", "lh", "--k-ring", "2", "--n-neighbors", "0", "--short"]) == 0
    assert binary.read_patch((surf.parent / "lh.flat.patch.3d").read_bytes())[1].tolist() == [i for i in range(25) if i not in (10, 11, 12)]
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_files_in_parts_are_the_files(spark, monkeypatch):
    monkeypatch.setattr(files, "RECORDS", 7)
    patch = spark.createDataFrame([("s", h, i, 3 * i, i / 2, float(-i), 1.0, i % 3 == 0) for h, n in (("lh", 30), ("rh", 5)) for i in range(n)], SCHEMAS["patch"])
    parts = files.encode_patches(patch)
    rows = parts.where("hemi = 'lh'").orderBy("part").collect()
    assert len(rows) == 5 and b"".join(bytes(r["content"]) for r in rows) == files.patch_bytes(patch.where("hemi = 'lh'").toPandas())
    assert sorted(map(tuple, files.decode_patches(parts).collect())) == sorted(map(tuple, patch.collect()))
    whole = parts.groupBy("subject", "hemi").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("p")).select("subject", "hemi", F.expr("aggregate(p.content, X'', (a, b) -> concat(a, b))").alias("content"))
    assert sorted(map(tuple, files.decode_patches(whole).collect())) == sorted(map(tuple, patch.collect()))
    curv = spark.createDataFrame([("s", "lh", i, i / 4) for i in range(20)], SCHEMAS["morph"])
    made = files.encode_curvatures(curv)
    assert made.count() == 3
    assert sorted(map(tuple, files.decode_curvatures(made).collect())) == sorted(map(tuple, curv.collect()))
