"""Readers and writers of mesh files. Files are read by Spark, so that any store works; (subject, hemi) come from the path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mesh
from ..operators.checkpoints import settled, write_file
from ..schema import KEY, SCHEMAS
from . import binary

#: Surfaces that a report is computed on, in order of choice.
BASE_SURFACES, REPORT_SURFACES = ("fiducial", "smoothwm"), ("fiducial", "white")


def path_key(path: Column) -> tuple[Column, Column]:
    """Subject and hemisphere of a file: the folder (that above, if it is `surf`), and the name's beginning lh. or rh."""
    parts = F.split(path, "/")
    folder = F.element_at(parts, -2)
    name = F.element_at(parts, -1)
    subject = F.when((folder == "surf") & (F.size(parts) > 2), F.try_element_at(parts, F.lit(-3))).otherwise(folder)
    return subject, F.regexp_extract(name, r"^(lh|rh)\.", 1)


def _decoded(spark: SparkSession, paths: str | list[str], schema: str, decode: Callable[[bytes], pd.DataFrame], tolerant: bool = False) -> DataFrame:
    """tolerant: a column `failure` more; a file that can't be decoded is one row with the reason there, in place of an error."""
    subject, hemi = path_key(F.col("path"))
    files = spark.read.format("binaryFile").load(paths).select(subject.alias("subject"), hemi.alias("hemi"), "path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                try:
                    out, failure = decode(row.content), None
                except ValueError as e:
                    if not tolerant:
                        raise ValueError(f"{row.path}: {e}") from e
                    out, failure = pd.DataFrame(index=[0], columns=empty), f"{row.path.rpartition('/')[2]}: {e}"
                out.insert(0, "subject", row.subject)
                out.insert(1, "hemi", row.hemi)
                if tolerant:
                    out["failure"] = failure
                yield out

    empty = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in KEY]
    return files.mapInPandas(run, schema + ", failure string" * tolerant)


def read_patches(spark: SparkSession, paths: str | list[str], *, tolerant: bool = False) -> DataFrame:
    """patch rows; pid is the place in the file. Raises on a wrong header or a short body."""

    def decode(raw: bytes) -> pd.DataFrame:
        xyz, ids, border = binary.read_patch(raw)
        return pd.DataFrame({"pid": np.arange(len(ids)), "vid": ids, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "is_border": border})

    return _decoded(spark, paths, SCHEMAS["patch"], decode, tolerant)


def read_vertices(spark: SparkSession, paths: str | list[str], *, tolerant: bool = False) -> DataFrame:
    def decode(raw: bytes) -> pd.DataFrame:
        xyz, _ = binary.read_surface(raw)
        return pd.DataFrame({"vid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return _decoded(spark, paths, "subject string, hemi string, vid long, x double, y double, z double", decode, tolerant)


def read_faces(spark: SparkSession, paths: str | list[str], *, tolerant: bool = False) -> DataFrame:
    def decode(raw: bytes) -> pd.DataFrame:
        _, faces = binary.read_surface(raw)
        return pd.DataFrame({"fid": np.arange(len(faces)), "a": faces[:, 0], "b": faces[:, 1], "c": faces[:, 2]})

    return _decoded(spark, paths, SCHEMAS["faces"], decode, tolerant)


def read_curvatures(spark: SparkSession, paths: str | list[str], *, tolerant: bool = False) -> DataFrame:
    def decode(raw: bytes) -> pd.DataFrame:
        values = binary.read_curvature(raw)
        return pd.DataFrame({"vid": np.arange(len(values)), "value": values})

    return _decoded(spark, paths, SCHEMAS["morph"], decode, tolerant)


def curvature_of_patch(curvature: DataFrame, patch: DataFrame) -> DataFrame:
    """Curvature at the patch's vertices; IndexError if the patch has ids beyond the curvature's."""
    top = curvature.groupBy(*KEY).agg(F.max("vid").alias("top"))
    if bad := patch.join(F.broadcast(top), KEY).where("vid > top").first():
        raise IndexError(f"{bad['subject']}/{bad['hemi']}: vertex {bad['vid']} has no curvature")
    return patch.join(curvature, [*KEY, "vid"]).select(*KEY, "pid", "vid", "value")


def _encoded(df: DataFrame, folder: str, file: str, encode: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """One file per mesh under folder/subject/hemi.file; returns (subject, hemi, path, n_bytes). The folder must be reachable by all workers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        subject, hemi = pdf["subject"].iloc[0], pdf["hemi"].iloc[0]
        raw, name = encode(pdf), f"{subject}/{hemi}.{file}"
        write_file(f"{folder}/{name}", raw)
        return pd.DataFrame({"subject": [subject], "hemi": [hemi], "path": [f"{folder}/{name}"], "n_bytes": [len(raw)]})

    return df.groupBy(*KEY).applyInPandas(run, "subject string, hemi string, path string, n_bytes long")


def patch_bytes(pdf: pd.DataFrame) -> bytes:
    own = pdf.sort_values("pid")
    return binary.write_patch(own[["x", "y", "z"]].to_numpy(), own["vid"].to_numpy(), own["is_border"].to_numpy(dtype=bool))


def write_patches(patch: DataFrame, folder: str, file: str = "patch.3d") -> DataFrame:
    return _encoded(patch, folder, file, patch_bytes)


#: Records of a part of a file that is made or read by several tasks.
RECORDS = 1 << 16
PARTS = "subject string, hemi string, part long, content binary"


def _in_parts(rows: DataFrame, place: str, encode: Callable[[pd.DataFrame], bytes], header: int, head: Callable[[int], bytes]) -> DataFrame:
    """PARTS of one file for each mesh: RECORDS rows each by their place, the header before the first. Joined in the order of `part` they are the file; no task holds it whole."""
    total = settled(rows.groupBy(*KEY).agg(F.count("*").alias("_n"), (F.min(place) - F.min(place) % RECORDS).alias("_low")))
    each = rows.join(mesh.each(total, total.count()), KEY).withColumn("part", F.floor((F.col(place) - F.col("_low")) / RECORDS).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        raw = encode(pdf.sort_values(place))[header:]
        return pd.DataFrame({"subject": [pdf["subject"].iloc[0]], "hemi": [pdf["hemi"].iloc[0]], "part": [part], "content": [(head(int(pdf["_n"].iloc[0])) if part == 0 else b"") + raw]})

    return each.groupBy(*KEY, "part").applyInPandas(run, PARTS)


def _from_parts(parts: DataFrame, header: int, size: int, first: str, decode: Callable[[bytes, bool], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of files in parts. A part holds whole records, and the lengths of those before it tell the place (column `first`) of its own. decode() is told whether a part begins with the header."""
    base = parts if "part" in parts.columns else parts.withColumn("part", F.lit(0).cast("long"))
    before = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lengths = base.select(*KEY, "part", F.octet_length("content").cast("long").alias("n"))
    places = lengths.select(*KEY, "part", F.sum("n").over(before).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                start = pd.isna(row.before)
                out = decode(bytes(row.content), start)
                out.insert(0, "subject", row.subject)
                out.insert(1, "hemi", row.hemi)
                out.insert(2, first, np.arange(len(out)) + (0 if start else (int(row.before) - header) // size))
                yield out

    return base.join(places, [*KEY, "part"]).select(*KEY, "content", "before").mapInPandas(run, schema)


def encode_patches(patch: DataFrame) -> DataFrame:
    """PARTS of the bytes that write_patches() would write; pid must be dense."""
    return _in_parts(patch, "pid", patch_bytes, binary.PATCH_HEADER, binary.patch_header)


def decode_patches(files: DataFrame) -> DataFrame:
    """patch rows of PARTS, or of whole files (subject, hemi, content)."""
    whole = "part" not in files.columns

    def decode(raw: bytes, start: bool) -> pd.DataFrame:
        xyz, ids, border = binary.read_patch(raw) if whole else binary.patch_records(raw[binary.PATCH_HEADER :] if start else raw)
        return pd.DataFrame({"vid": ids, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "is_border": border})

    return _from_parts(files, binary.PATCH_HEADER, binary.PATCH_RECORD.itemsize, "pid", decode, SCHEMAS["patch"])


def encode_curvatures(curvature: DataFrame) -> DataFrame:
    """PARTS of curvature files; vertices must be dense from 0."""
    return _in_parts(curvature, "vid", lambda pdf: binary.write_curvature(pdf["value"].to_numpy()), binary.CURVATURE_HEADER, binary.curvature_header)


def decode_curvatures(contents: DataFrame) -> DataFrame:
    """morph rows of PARTS, or of whole files (subject, hemi, content)."""
    whole = "part" not in contents.columns

    def decode(raw: bytes, start: bool) -> pd.DataFrame:
        values = binary.read_curvature(raw) if whole else binary.curvature_values(raw[binary.CURVATURE_HEADER :] if start else raw)
        return pd.DataFrame({"value": values})

    return _from_parts(contents, binary.CURVATURE_HEADER, 4, "vid", decode, SCHEMAS["morph"])


# --- text formats -----------------------------------------------------------------------------------------------------


def label_lines(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """Lines of a label file by mesh: line_no, line. A comment, the count, then id, coordinates and 1.0 in the order of ids."""
    rows = members.select(*KEY, "vid").distinct().join(vertices, [*KEY, "vid"])
    each = F.sort_array(F.collect_list(F.struct("vid", F.format_string("%d %.6f %.6f %.6f %.6f", "vid", "x", "y", "z", F.lit(1.0)).alias("line"))))
    head = F.format_string("#!ascii label, from subject %s hemi %s", "subject", "hemi")
    grouped = rows.groupBy(*KEY).agg(each.alias("r"))
    lines = F.concat(F.array(head, F.size("r").cast("string")), F.col("r.line"))
    return grouped.select(*KEY, F.posexplode(lines).alias("line_no", "line"))


def write_labels(members: DataFrame, vertices: DataFrame, folder: str, name: str) -> DataFrame:
    lines = label_lines(members, vertices)
    return _encoded(lines, folder, f"{name}.label", lambda pdf: ("\n".join(pdf.sort_values("line_no")["line"]) + "\n").encode())


def parse_labels(lines: DataFrame) -> DataFrame:
    """vid of label lines (subject, hemi, line): those with five fields or more whose first is a number; comments, counts and blank lines are passed over."""
    fields = F.split(F.btrim("line"), r"\s+")
    ok = ~F.startswith(F.btrim("line"), F.lit("#")) & (F.size(fields) >= 5) & F.get(fields, F.lit(0)).rlike(r"^\d+$")
    return lines.where(ok).select(*KEY, F.get(fields, F.lit(0)).cast("long").alias("vid"))


def read_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    subject, hemi = path_key(F.input_file_name())
    return parse_labels(spark.read.text(paths).select(subject.alias("subject"), hemi.alias("hemi"), F.col("value").alias("line")))


def parse_template(texts: DataFrame, hemi: str) -> DataFrame:
    """name, vid, ord of a template's JSON text (column value) for one hemisphere: keys are hemi_cut, those of the other hemisphere are left out."""
    pairs = texts.select(F.explode(F.from_json("value", "map<string,array<bigint>>")).alias("key", "ids"))
    own = pairs.where(F.startswith("key", F.lit(f"{hemi}_"))).select(F.substring("key", len(hemi) + 2, 1000).alias("name"), "ids")
    return own.select("name", F.posexplode("ids").alias("ord", "vid")).select("name", "vid", "ord")


def read_template(spark: SparkSession, path: str, hemi: str) -> DataFrame:
    return parse_template(spark.read.text(path, wholetext=True), hemi)


def template_json(cuts: DataFrame) -> DataFrame:
    """value: one JSON object over all hemispheres, keys hemi_cut."""
    each = cuts.groupBy("hemi", "name").agg(F.sort_array(F.collect_list(F.struct("ord", "vid"))).alias("r"))
    entries = F.sort_array(F.collect_list(F.struct(F.concat_ws("_", "hemi", "name").alias("key"), F.col("r.vid").alias("value"))))
    return each.groupBy().agg(F.to_json(F.map_from_entries(entries)).alias("value"))


# The texts that open a line of the optimiser's log.
LOG_INPUT, LOG_END, LOG_FLIPPED, LOG_ERROR = "Input patch:", "FINAL RESULT", "Flipped triangles:", "Mean % distance error:"


def parse_logs(texts: DataFrame) -> DataFrame:
    """distance_error, flipped, subject, hemisphere of whole log texts (column value); null where the text doesn't tell."""
    rows = texts.select(F.transform(F.split("value", r"\r?\n"), lambda x: F.btrim(x)).alias("rows"))
    rows = rows.withColumn("at", F.array_position("rows", LOG_END)).withColumn("end", F.when(F.col("at") > 0, F.slice("rows", F.greatest(F.col("at"), F.lit(1)), F.size("rows"))))

    def field(lines: str, mark: str) -> Column:
        line = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(mark))), F.lit(0))
        return F.btrim(F.substring(line, len(mark) + 1, 1 << 30))

    path = field("rows", LOG_INPUT)
    subject, hemi = path_key(path)
    after = F.btrim(F.get(F.split(field("end", LOG_FLIPPED), "->"), F.lit(1)))
    return rows.select(
        F.rtrim(field("end", LOG_ERROR), F.lit("%")).try_cast("double").alias("distance_error"), after.try_cast("long").alias("flipped"),
        F.when(path != "", subject).alias("subject"), F.when(hemi != "", hemi).alias("hemisphere"),
    )


def log_texts(runs: DataFrame) -> DataFrame:
    """subject, hemi, value: the end of the optimiser's log for each mesh of run_metrics(), with the path of its input (column `input`), in the form that parse_logs() takes."""
    number = lambda c: F.format_string("%d", c)
    lines = F.array(
        F.concat(F.lit(f"{LOG_INPUT} "), "input"), F.lit(""), F.lit(LOG_END), F.concat(F.lit(f"  {LOG_FLIPPED} "), number("flipped_initial"), F.lit(" -> "), number("flipped_final")),
        F.concat(F.lit(f"  {LOG_ERROR} "), F.format_string("%.2f", "pct_error"), F.lit("%")),
    )
    return runs.select(*KEY, F.array_join(lines, "\n").alias("value"))


def write_logs(runs: DataFrame, folder: str) -> None:
    """log_texts() as text files under folder/subject=.../hemi=..., written by tasks; those of other meshes stay."""
    log_texts(runs).repartition(*KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).text(folder)


def read_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_logs(spark.read.text(paths, wholetext=True))


# --- finding files ----------------------------------------------------------------------------------------------------


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """subject, hemi, kind, path of the hemispheres' files (lh.kind, rh.kind) below a folder; none of them is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[lr]h.*").load(folder)
    subject, hemi = path_key(F.col("path"))
    return found.select(subject.alias("subject"), hemi.alias("hemi"), F.substring(F.element_at(F.split("path", "/"), -1), 4, 1000).alias("kind"), "path")


def first_surface(files: DataFrame, order: tuple[str, ...] = BASE_SURFACES) -> DataFrame:
    """subject, hemi, path of the surface that comes first in `order`, of each hemisphere that has any."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    return files.where(rank > 0).groupBy(*KEY).agg(F.min_by("path", rank).alias("path"))


def base_surface(paths: list[str], patch: str, order: tuple[str, ...] = BASE_SURFACES) -> str | None:
    """Of the listed files the surface beside a patch that comes first in `order`; the patch's name must begin with lh. or rh."""
    folder, _, name = patch.rpartition("/")
    if name[:3] not in ("lh.", "rh."):
        return None
    there = set(paths)
    return next((p for s in order if (p := f"{folder}/{name[:3]}{s}") in there), None)


def detect_curvature(paths: list[str], surf: str, hint: str, tops: dict[str, int], top: int) -> str | None:
    """Of the listed files the curvature that a patch with ids up to `top` goes with: that of the hemisphere in the hint's name, else lh, else rh; files whose last vertex (tops) is below are passed over."""
    name = hint.rpartition("/")[2]
    hemis = [h for h in ("lh", "rh") if name.startswith(f"{h}.")] or ["lh", "rh"]
    found = [f"{surf}/{h}.curv" for h in hemis]
    return next((p for p in found if p in paths and tops.get(p, -1) >= top), None)


def complete_subjects(files: DataFrame, pattern: str = r"^(lh|rh)\..*flat.*\.3d$") -> DataFrame:
    """subject of those files (column path) that have a flat patch of both hemispheres."""
    subject, hemi = path_key(F.col("path"))
    flat = files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern)).select(subject.alias("subject"), hemi.alias("hemi"))
    return flat.groupBy("subject").agg(F.count_distinct("hemi").alias("n")).where("n = 2").select("subject")


def read_surface(spark: SparkSession, subject: str, kind: str, hemi: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a subject's surface; FileNotFoundError if there is none."""
    path = surface_path(subject, kind, hemi, folder)
    try:
        return read_vertices(spark, path), read_faces(spark, path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no surface {path}") from e


def surface_path(subject: str, kind: str, hemi: str, folder: str | None = None) -> str:
    """Path of a subject's surface. The folder given wins over SUBJECTS_DIR."""
    import os

    root = folder or os.environ.get("SUBJECTS_DIR")
    if not root:
        raise ValueError("no folder of subjects is given, and SUBJECTS_DIR isn't set")
    return f"{root}/{subject}/surf/{hemi}.{kind}"
