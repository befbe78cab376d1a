"""Command line for spark-submit: run, project, flatten, batch, report, view, template, snapshots. A bare folder means run.

Every command works on one or both hemispheres of a subject folder and prints a status line for each; the exit code is 1 if any failed.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders
from .config import FlattenConfig, Phase
from .operators import cuts, flatten, mesh, metrics, report, snapshots, topology
from .operators.checkpoints import settled
from .schema import KEY
from .sources import files, store

COMMANDS = ("run", "project", "flatten", "batch", "report", "view", "template", "snapshots")


def session() -> SparkSession:
    return SparkSession.builder.appName("meshql").getOrCreate()


def config_of(args: argparse.Namespace) -> FlattenConfig:
    """The JSON file's options; those given on the command line win."""
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            config = FlattenConfig.from_json(f.read())
    else:
        config = FlattenConfig()
    if args.k_ring is not None:
        config.kring.k_ring = args.k_ring
    if args.n_neighbors is not None:
        config.kring.n_neighbors_per_ring = args.n_neighbors or None
    if args.short:
        config.phases = [Phase("short", 1.0, 1.0, [4, 1, 0], 5)]
        config.negative_area_removal.enabled = config.final_negative_area_removal.enabled = False
    return config


def _beside(path: str) -> list[str]:
    folder = os.path.dirname(path)
    return [f"{folder}/{n}" for n in os.listdir(folder)] if os.path.isdir(folder) else []


def _write(patch: DataFrame, path: str) -> None:
    rows = files.encode_patches(patch).orderBy("part").select("content").toLocalIterator()  # one hemisphere's file
    part = f"{path}.part"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(part, "wb") as f:
        for row in rows:
            f.write(bytes(row["content"]))
    os.replace(part, path)


def project(spark: SparkSession, folder: str, hemi: str, template: str, output: str, overwrite: bool, refine: bool = False) -> str:
    """Template cuts made continuous, refined if asked for, holes filled, and the rest of the inflated surface written as a patch."""
    if os.path.exists(output) and not overwrite:
        return output
    surf = folder if os.path.basename(folder) == "surf" else f"{folder}/surf"
    inflated, tri = files.read_vertices(spark, f"{surf}/{hemi}.inflated").cache(), files.read_faces(spark, f"{surf}/{hemi}.inflated").cache()
    adj = settled(mesh.mesh_graph(tri, folders.ground(spark, surf, hemi)))
    key = inflated.select(*KEY).distinct()
    own = files.read_template(spark, template, hemi).crossJoin(F.broadcast(key.limit(1))).select(*KEY, "name", "vid", "ord")
    wall = own.where("name = 'mwall'").select(*KEY, "vid")
    lines = settled(cuts.continuous(adj, inflated, own.where("name <> 'mwall'")))
    if refine:
        lines = settled(cuts.refine(adj, inflated, lines, wall))
    gone = settled(wall.unionByName(lines.select(*KEY, "vid")).distinct())
    gone = settled(gone.unionByName(topology.fill_holes(tri, gone)).distinct())
    _write(mesh.build_patch(inflated, tri, gone), output)
    return output


def flatten_patch(spark: SparkSession, patch: str, base: str | None, output: str, config: FlattenConfig, overwrite: bool) -> str:
    if os.path.exists(output) and not overwrite:
        return output
    base = base or files.base_surface(_beside(patch), patch)
    if base is None:
        raise FileNotFoundError(f"no base surface beside {patch}")
    rows = files.read_patches(spark, patch).cache()
    tri = settled(mesh.patch_faces(files.read_faces(spark, base).drop(*KEY).crossJoin(F.broadcast(rows.select(*KEY).limit(1))).select(*KEY, "fid", "a", "b", "c"), rows))
    own = rows.select(*KEY, F.col("pid").alias("vid"), "x", "y", "z")
    places = files.read_vertices(spark, base).select(F.col("vid").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    solid = rows.join(places, F.col("vid") == F.col("v")).select(*KEY, F.col("pid").alias("vid"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"))
    job = flatten.Flattener(config).load(own, tri).compute_distances(solid)
    job.run()
    flat = job.result().join(rows.select(*KEY, F.col("pid").alias("vid"), F.col("vid").alias("orig"), "is_border"), [*KEY, "vid"])
    _write(flat.select(*KEY, F.col("vid").alias("pid"), F.col("orig").alias("vid"), F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0.0).alias("z"), "is_border"), output)
    return output


def report_patch(spark: SparkSession, flat: str, base: str | None, method: str) -> DataFrame:
    base = base or files.base_surface(_beside(flat), flat, files.REPORT_SURFACES)
    if base is None:
        raise FileNotFoundError(f"no surface beside {flat}")
    rows = files.read_patches(spark, flat).cache()
    tri = settled(mesh.patch_faces(files.read_faces(spark, base).drop(*KEY).crossJoin(F.broadcast(rows.select(*KEY).limit(1))).select(*KEY, "fid", "a", "b", "c"), rows))
    places = files.read_vertices(spark, base).select(F.col("vid").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    solid = rows.join(places, F.col("vid") == F.col("v")).select(*KEY, F.col("pid").alias("vid"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"))
    uv = rows.select(*KEY, F.col("pid").alias("vid"), F.col("x").alias("u"), F.col("y").alias("v"))
    solid, kring = settled(solid), settled(report.method_rings(method, tri, solid))
    return report.flatmap_report(solid, uv, tri, kring).join(report.median_distortion(metrics.vertex_distortion(kring, uv)), KEY)


def view_patch(spark: SparkSession, patch: str, view: str, output: str) -> str:
    """The inflated surface beside a patch as a view shows it, what isn't in the patch as cut; written as Parquet."""
    folder, name = os.path.split(patch)
    surf = folder if os.path.exists(f"{folder}/{name[:3]}inflated") else f"{folder}/surf"
    own, tri = files.read_vertices(spark, f"{surf}/{name[:3]}inflated").cache(), files.read_faces(spark, f"{surf}/{name[:3]}inflated")
    curv = f"{surf}/{name[:3]}curv"
    shade = files.read_curvatures(spark, curv) if os.path.exists(curv) else own.select(*KEY, "vid", F.lit(0.0).alias("value"))
    report.view_faces(own, tri, shade, files.read_patches(spark, patch).select(*KEY, "vid"), name[:2], view).write.mode("overwrite").parquet(output)
    return output


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="meshql", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    options = argparse.ArgumentParser(add_help=False)
    options.add_argument("--overwrite", action="store_true")
    options.add_argument("--config")
    options.add_argument("--k-ring", type=int)
    options.add_argument("--n-neighbors", type=int, help="samples of each ring; 0 takes all")
    options.add_argument("--short", action="store_true", help="a few steps only")
    for name in ("run", "project"):
        p = sub.add_parser(name, parents=[options])
        p.add_argument("folder")
        p.add_argument("--template", required=True)
        p.add_argument("--hemi", choices=["lh", "rh", "both"], default="both")
        p.add_argument("--refine", action="store_true")
    p = sub.add_parser("flatten", parents=[options])
    p.add_argument("patch")
    p.add_argument("--base")
    p.add_argument("--output")
    p = sub.add_parser("batch", parents=[options])
    p.add_argument("folder", help="of subjects")
    p.add_argument("--output", help="where the flat patches go, by subject; default: the folder")
    p = sub.add_parser("report")
    p.add_argument("patch", help="a flat patch, or a folder of subjects")
    p.add_argument("--base")
    p.add_argument("--method", default="fast", choices=["fast", "sampled"])
    p = sub.add_parser("view", help="the faces that a view of the projection shows, as a table")
    p.add_argument("patch")
    p.add_argument("--view", default="medial", choices=["medial", "ventral", "frontal"])
    p.add_argument("--output", required=True)
    p = sub.add_parser("template", help="cuts of a subject's patches, as the JSON that project takes")
    p.add_argument("folder")
    p.add_argument("--patch", default="cut.patch.3d", help="the patches' name after lh. and rh.")
    p.add_argument("--output", required=True)
    p = sub.add_parser("snapshots")
    p.add_argument("path")
    p.add_argument("--frames", type=int, default=100)
    p.add_argument("--output", help="a folder for the table of frames; without it boxes are printed")
    p.add_argument("--fps", type=float, default=15.0)
    return out


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and os.path.isdir(argv[0]):
        argv.insert(0, "run")
    args = parser().parse_args(argv)
    spark, failed = session(), 0

    def step(label: str, work) -> object:  # noqa: ANN001
        nonlocal failed
        try:
            done = work()
        except (ValueError, OSError, RuntimeError, PySparkException) as e:
            failed += 1
            print(f"{label}: failed: {e}")
            return None
        print(f"{label}: {done}")
        return done

    if args.command in ("run", "project"):
        for hemi in ("lh", "rh") if args.hemi == "both" else (args.hemi,):
            patch = f"{args.folder}/{hemi}.cut.patch.3d"
            made = step(f"project {hemi}", lambda hemi=hemi, patch=patch: project(spark, args.folder, hemi, args.template, patch, args.overwrite, args.refine))
            if made and args.command == "run":
                surf = args.folder if os.path.basename(args.folder) == "surf" else f"{args.folder}/surf"
                base = files.base_surface(_beside(f"{surf}/x"), f"{surf}/{hemi}.x")
                step(f"flatten {hemi}", lambda hemi=hemi, patch=patch, base=base: flatten_patch(spark, patch, base, f"{args.folder}/{hemi}.flat.patch.3d", config_of(args), args.overwrite))
    elif args.command == "flatten":
        folder, name = os.path.split(args.patch)
        output = args.output or f"{folder}/{name[:3]}flat.patch.3d"
        step("flatten", lambda: flatten_patch(spark, args.patch, args.base, output, config_of(args), args.overwrite))
    elif args.command == "batch":
        rows: list = []
        step("batch", lambda: f"{rows.extend(folders.flatten_folder(spark, args.folder, args.output or args.folder, config_of(args), args.overwrite).orderBy(*KEY).collect()) or len(rows)} hemispheres")
        for r in rows:
            failed += r["status"] == "error"
            print(f"{r['subject']} {r['hemi']}: {r['status']}" + (f": {r['error']}" if r["error"] else ""))
    elif args.command == "view":
        step("view", lambda: view_patch(spark, args.patch, args.view, args.output))
    elif args.command == "template":
        step("template", lambda: folders.derive_template(spark, args.folder, args.patch, args.output))
    elif args.command == "report" and os.path.isdir(args.patch):
        step("report", lambda: [r.asDict() for r in folders.report_folder(spark, args.patch, args.method).orderBy(*KEY).collect()])
    elif args.command == "report":
        step("report", lambda: [r.asDict() for r in report_patch(spark, args.patch, args.base, args.method).collect()])
    elif args.output:
        step("snapshots", lambda: folders.write_frames(store.read_snapshots(spark, args.path), args.frames, args.fps, args.output))
    else:
        step("snapshots", lambda: [r.asDict() for r in snapshots.boxes(snapshots.sampled(store.read_snapshots(spark, args.path), args.frames)).orderBy("step").collect()])
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
