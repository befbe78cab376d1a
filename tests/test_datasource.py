"""The meshfiles format: files chosen before they are opened, all files written or none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshql.operators import mesh
from meshql.plans.meshgen import plain_grid
from meshql.sources import binary, datasource, files

from .test_batch import grid


@pytest.fixture
def folder(tmp_path):
    for i, subject in enumerate(("s1", "s2", "s3")):
        for hemi in ("lh", "rh"):
            v, f = grid(4 + i)
            surf = tmp_path / subject / "surf"
            surf.mkdir(parents=True, exist_ok=True)
            (surf / f"{hemi}.inflated").write_bytes(binary.write_surface(v, f))
            (surf / f"{hemi}.curv").write_bytes(binary.write_curvature(v[:, 2]))
            (tmp_path / subject / f"{hemi}.cut.patch.3d").write_bytes(binary.write_patch(v[:5], np.arange(5), np.arange(5) % 2 == 0))
    (tmp_path / "s3" / "surf" / "rh.inflated").write_bytes(b"broken")
    (tmp_path / "s1" / "notes.txt").write_text("no mesh")
    return tmp_path


def same(a, b):
    order = sorted(a.columns)
    assert sorted(map(tuple, a.select(order).collect())) == sorted(map(tuple, b.select(order).collect()))


def test_reads_what_the_readers_read(spark, folder):
    for kind, file, read in (("patch", "cut.patch.3d", files.read_patches), ("curvature", "curv", files.read_curvatures)):
        found = datasource.load(spark, str(folder), kind, file)
        paths = [str(p) for p in folder.rglob(f"*h.{file}")]
        same(found, read(spark, paths))
        assert found.rdd.getNumPartitions() == 6
    for kind, read in (("vertices", files.read_vertices), ("faces", files.read_faces)):
        same(datasource.load(spark, str(folder), kind, "infl*", subject="s2"), read(spark, [str(folder / "s2" / "surf" / f"{h}.inflated") for h in ("lh", "rh")]))
    with pytest.raises(Exception, match="option kind is one of"):
        datasource.load(spark, str(folder), "nothing")


def test_filters_choose_files(spark, folder):
    """rh of s3 can't be read; whether it is opened shows."""
    key = "spark.sql.python.filterPushdown.enabled"
    old = spark.conf.get(key)
    try:
        for on in ("true", "false"):
            spark.conf.set(key, on)
            every = datasource.load(spark, str(folder), "vertices", "inflated")
            with pytest.raises(Exception, match="not a triangle surface"):
                every.count()
            some = every.where("subject in ('s1', 's3') and hemi = 'lh' and x > 0.5").select("subject", "vid")
            if on == "true":
                assert {r["subject"] for r in some.collect()} == {"s1", "s3"} and some.rdd.getNumPartitions() == 2
                assert every.where("subject = 'none'").count() == 0 and every.where("subject = 's1' and subject = 's2'").count() == 0
            else:
                with pytest.raises(Exception, match="not a triangle surface"):
                    some.count()
            assert datasource.load(spark, str(folder), "vertices", "inflated", subject="s3", hemi="lh").count() == 36
    finally:
        spark.conf.set(key, old)


def patches(spark, n):
    one = plain_grid(spark, 3)
    patch = mesh.build_patch(one.vertices, one.faces, one.points.where("vid = 0").select("subject", "hemi", "vid"))
    return patch.drop("subject").crossJoin(spark.range(n).select(F.format_string("s%d", "id").alias("subject")))


def test_writes_all_files(spark, tmp_path):
    own = patches(spark, 5)
    datasource.save(own, str(tmp_path), "patch", "cut.patch.3d")
    same(datasource.load(spark, str(tmp_path), "patch", "cut.patch.3d").select(own.columns), own)
    files.write_patches(own.where("subject = 's1'"), str(tmp_path / "other"), "cut.patch.3d").collect()
    assert (tmp_path / "s1" / "lh.cut.patch.3d").read_bytes() == (tmp_path / "other" / "s1" / "lh.cut.patch.3d").read_bytes()
    assert not list(tmp_path.glob("_staging*"))
    before = {p: p.read_bytes() for p in tmp_path.rglob("*.3d")}
    with pytest.raises(Exception, match="is there already"):
        datasource.save(own.withColumn("x", F.col("x") + 1), str(tmp_path), "patch", "cut.patch.3d")
    assert before == {p: p.read_bytes() for p in tmp_path.rglob("*.3d")} and not list(tmp_path.glob("_staging*"))
    datasource.save(own.withColumn("x", F.col("x") + 1), str(tmp_path), "patch", "cut.patch.3d", overwrite=True)
    assert before != {p: p.read_bytes() for p in tmp_path.rglob("*.3d")}


def test_writes_labels(spark, tmp_path):
    one = plain_grid(spark, 3)
    lines = files.label_lines(one.vertices.where("vid < 4").select("subject", "hemi", "vid"), one.vertices)
    datasource.save(lines, str(tmp_path), "label", "wall.label")
    found = files.read_labels(spark, str(tmp_path / "grid" / "lh.wall.label"))
    assert sorted(map(tuple, found.collect())) == [("grid", "lh", i) for i in range(4)]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    # ids beyond 32 bits don't fit in the file: the task of s3 fails after others have written theirs
    own = patches(spark, 6).withColumn("vid", F.when(F.col("subject") == "s3", F.lit(None).cast("long")).otherwise(F.col("vid")))
    with pytest.raises(Exception):  # noqa: B017, PT011
        datasource.save(own, str(tmp_path), "patch", "cut.patch.3d")
    assert not list(tmp_path.rglob("*.3d")) and not list(tmp_path.glob("_staging*"))
    with pytest.raises(Exception, match="two tasks|stand together"):
        patches(spark, 1).repartition(4).write.format(datasource.FORMAT).options(kind="patch", file="p.3d").mode("append").save(str(tmp_path))
    assert not list(tmp_path.rglob("*.3d")) and not list(tmp_path.glob("_staging*"))
