"""Reports, templates, frames, logs and views of folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshql import cli, folders
from meshql.operators import flatten, mesh, metrics, report, template
from meshql.sources import binary, files

from .test_batch import grid, short, tables


def put(path, subject, hemi, *, scale=1.0, base="fiducial", log=None, width=7):
    v, f = grid(width)
    surf = path / subject / "surf"
    surf.mkdir(parents=True, exist_ok=True)
    for kind in (base, "inflated"):
        (surf / f"{hemi}.{kind}").write_bytes(binary.write_surface(v * (1 if kind == "inflated" else 1.25), f))
    (surf / f"{hemi}.flat.patch.3d").write_bytes(binary.write_patch(v[3:] * [scale, 1, 0], np.arange(3, len(v))))
    if log:
        (surf / f"{hemi}.flat.log").write_text(f"Input patch: /data/{subject}/{hemi}.cut.patch.3d\n\nFINAL RESULT\n  Flipped triangles: 7 -> 2\n  Mean % distance error: {log}%\n")


def test_report_of_a_folder(spark, tmp_path, capsys):
    put(tmp_path, "one", "lh", log="12.34")
    put(tmp_path, "one", "rh", scale=2.0)
    put(tmp_path, "two", "lh", scale=9.0)
    put(tmp_path, "three", "lh", base="white")
    put(tmp_path, "three", "rh", base="other")
    found = {(r["subject"], r["hemi"]): r for r in folders.report_folder(spark, str(tmp_path)).collect()}
    assert len(found) == 5 and found["three", "rh"]["error"] == "no base surface" and found["three", "rh"]["n_faces"] is None
    one = found["one", "lh"]
    assert one["log_error"] == 12.34 and found["one", "rh"]["log_error"] is None and one["error"] is None
    assert len(one["histogram"]) == 50 and sum(one["histogram"]) == 46 and one["n_faces"] == 72 - 5
    # a grid needs both hemispheres; the widest of those that have them sets the shared limit
    assert found["two", "lh"]["shared_limit"] is None and found["three", "lh"]["own_limit"] is None
    assert one["own_limit"] == one["shared_limit"] == found["one", "rh"]["half"] > one["half"]
    # the same as of one patch alone
    alone = cli.report_patch(spark, str(tmp_path / "one" / "surf" / "lh.flat.patch.3d"), None, "fast").first()
    assert all(abs(alone[c] - one[c]) < 1e-9 for c in ("pct_error", "area_3d", "j_a", "median", "mean"))
    assert cli.main(["report", str(tmp_path)]) == 0 and "shared_limit" in capsys.readouterr().out
    assert folders.report_folder(spark, str(tmp_path / "three" / "surf")).count() == 2


def test_histogram_array(spark):
    d = spark.createDataFrame([("a", "lh", 0, 0.0), ("a", "lh", 1, 3.9), ("a", "lh", 2, 250.0)], "subject string, hemi string, vid long, distortion double")
    (row,) = report.histogram_array(d).collect()
    assert row["histogram"] == [1, 1] + [0] * 47 + [1]


def test_template_of_both_hemispheres(spark, tmp_path):
    width = 30
    v, f = grid(width)
    ix, iy = np.arange(900) % width, np.arange(900) // width
    wall = (ix > 12) & (ix < 18) & (iy > 12) & (iy < 18)
    lines = [(iy == 15) & (ix <= 12), (iy == 15) & (ix >= 18), (ix == 15) & (iy <= 12)]
    surf = tmp_path / "s" / "surf"
    surf.mkdir(parents=True)
    gone = wall | lines[0] | lines[1] | lines[2]
    for hemi in ("lh", "rh"):
        turned = v[:, [2, 0, 1]] * (1 if hemi == "lh" else -1)
        for kind in ("inflated", "smoothwm"):
            (surf / f"{hemi}.{kind}").write_bytes(binary.write_surface(turned, f))
        keep = np.flatnonzero(~gone)
        (surf / f"{hemi}.cut.patch.3d").write_bytes(binary.write_patch(turned[keep], keep))
    assert cli.main(["template", str(tmp_path), "--output", str(tmp_path / "json")]) == 0
    (text,) = [r["value"] for r in spark.read.text(str(tmp_path / "json")).collect()]
    found = json.loads(text)
    assert {k.split("_")[0] for k in found} == {"lh", "rh"} and {"lh_mwall", "rh_mwall", "lh_temporal", "rh_temporal"} <= set(found)
    for hemi in ("lh", "rh"):
        # read back by the reader of templates, hemisphere by hemisphere, the rows are those of the operator alone
        got = sorted((r["name"], r["vid"]) for r in files.read_template(spark, str(tmp_path / "json"), hemi).collect())
        own, tri = files.read_vertices(spark, str(surf / f"{hemi}.inflated")), files.read_faces(spark, str(surf / f"{hemi}.inflated"))
        want = template.derive(own, tri, mesh.faces_within(tri, own.where(~F.col("vid").isin(np.flatnonzero(gone).tolist()))))
        assert got == sorted((r["name"], r["vid"]) for r in want.collect()) and len(got) >= gone.sum()
    with pytest.raises(FileNotFoundError):
        folders.derive_template(spark, str(tmp_path), "none.3d", str(tmp_path / "x"))


def test_three_surfaces(spark, tmp_path):
    put(tmp_path, "one", "lh")
    rows = folders.three_surfaces(spark, files.listing(spark, str(tmp_path)), "flat.patch.3d").orderBy("vid").collect()
    assert len(rows) == 49 and rows[2]["u"] is None and rows[8]["u"] == pytest.approx(rows[8]["x"]) and rows[8]["fx"] == pytest.approx(1.25 * rows[8]["x"])


def test_ground_falls_back(spark, tmp_path):
    v, f = grid(3)
    surf = tmp_path / "s" / "surf"
    surf.mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        folders.ground(spark, str(surf), "lh")
    for kind, factor in (("inflated", 5), ("pial", 3), ("smoothwm", 1)):
        (surf / f"lh.{kind}").write_bytes(binary.write_surface(v * factor, f))
        want = {"inflated": 5, "pial": 3, "smoothwm": 2}[kind]  # with both, halfway
        got = [r["y"] for r in folders.ground(spark, str(surf), "lh").orderBy("vid").collect()]
        assert got == [want * y for y in v[:, 1]]
    (surf / "lh.fiducial").write_bytes(binary.write_surface(v * 7, f))
    assert folders.ground(spark, str(surf), "lh").agg(F.max("y")).first()[0] == 14
    assert files.read_surface(spark, "s", "pial", "lh", str(tmp_path))[1].count() == 8
    with pytest.raises(FileNotFoundError, match="no surface"):
        files.read_surface(spark, "s", "white", "lh", str(tmp_path))


def test_logs_are_read_back(spark, tmp_path):
    v, f = tables(spark, {("a", "lh"): grid(6), ("b", "rh"): grid(5)})
    config = short()
    job = flatten.Flattener(config).load(v, f).compute_distances()
    runs = flatten.run_metrics(job.run(), job.kring, job.vertices).withColumn("input", F.concat(F.lit("/data/"), "subject", F.lit("/"), "hemi", F.lit(".cut.patch.3d"))).cache()
    for _ in range(2):
        files.write_logs(runs, str(tmp_path / "logs"))
    files.write_logs(runs.where("subject = 'a'"), str(tmp_path / "logs"))
    paths = [str(p) for p in (tmp_path / "logs").rglob("*.txt")]
    got = sorted((r["subject"], r["hemisphere"], r["flipped"], r["distance_error"]) for r in files.read_logs(spark, paths).collect())
    assert got == sorted((r["subject"], r["hemi"], r["flipped_final"], float(f"{r['pct_error']:.2f}")) for r in runs.collect()) and len(got) == 2


def test_frames_and_views(spark, tmp_path):
    v, f = tables(spark, {("a", "lh"): grid(6)})
    config = short()
    job = flatten.Flattener(config).load(v, f).compute_distances()
    job.run(keep_every=1).write.parquet(str(tmp_path / "shots"))
    assert cli.main(["snapshots", str(tmp_path / "shots"), "--frames", "4", "--output", str(tmp_path / "frames"), "--fps", "2"]) == 0
    rows = spark.read.parquet(str(tmp_path / "frames")).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in rows] == list(range(len(rows))) and len(rows) > 4 and rows[0]["half"] > 0 and rows[0]["label"]
    put(tmp_path / "in", "one", "lh")
    patch = tmp_path / "in" / "one" / "surf" / "lh.flat.patch.3d"
    assert cli.main(["view", str(patch), "--output", str(tmp_path / "view")]) == 0
    seen = spark.read.parquet(str(tmp_path / "view"))
    whole = metrics.face_areas_3d(*(files.read_faces(spark, str(patch.parent / "lh.inflated")), files.read_vertices(spark, str(patch.parent / "lh.inflated")))).count()
    assert 0 < seen.count() <= whole and seen.where("is_cut").count() < seen.count()
