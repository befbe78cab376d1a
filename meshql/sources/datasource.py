"""Mesh files as a Spark data source: spark.read.format("meshfiles") and df.write.format("meshfiles").

    register(spark)
    spark.read.format("meshfiles").option("kind", "patch").option("file", "cut.patch.3d").load(folder).where("subject = 's1' and hemi = 'lh'")

A partition is a file. Filters on subject and hemi choose the files before any is opened, with option pushdown in a session that has spark.sql.python.filterPushdown.enabled
(load() looks); the options subject and hemi do so in any session. The writer makes patch and label files of rows that are grouped by mesh, see save(): tasks write beside their target, and only when all of them are done does the
driver give the files their names; if one fails, nothing is left.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.checkpoints import file_system
from ..schema import KEY
from . import binary, files

FORMAT, PUSHDOWN = "meshfiles", "spark.sql.python.filterPushdown.enabled"
#: kind: (schema without the keys, what a file's bytes become).
KINDS = {
    "patch": ("pid long, vid long, x double, y double, z double, is_border boolean", lambda raw: _patch(*binary.read_patch(raw))),
    "vertices": ("vid long, x double, y double, z double", lambda raw: _numbered("vid", binary.read_surface(raw)[0], "xyz")),
    "faces": ("fid long, a long, b long, c long", lambda raw: _numbered("fid", binary.read_surface(raw)[1], "abc")),
    "curvature": ("vid long, value double", lambda raw: _numbered("vid", binary.read_curvature(raw)[:, None], ["value"])),
}
#: ... and those that can be written: columns that rows need, and how a mesh's rows become bytes.
WRITABLE = {
    "patch": (["pid", "vid", "x", "y", "z", "is_border"], lambda own: files.patch_bytes(own)),
    "label": (["line_no", "line"], lambda own: ("\n".join(own.sort_values("line_no")["line"]) + "\n").encode()),
}


def _patch(xyz: np.ndarray, ids: np.ndarray, border: np.ndarray) -> dict:
    return {"pid": np.arange(len(ids)), "vid": ids, **{a: np.ascontiguousarray(xyz[:, i]) for i, a in enumerate("xyz")}, "is_border": border}


def _numbered(name: str, rows: np.ndarray, columns: Iterable[str]) -> dict:
    return {name: np.arange(len(rows)), **{c: np.ascontiguousarray(rows[:, i]) for i, c in enumerate(columns)}}


@dataclass
class MeshFile(InputPartition):
    uri: str
    subject: str
    hemi: str


class MeshReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.kind, self.pattern = options["path"], options["kind"], options.get("file", "*")
        self.schema = schema
        self.wanted = {c: {options[c]} for c in KEY if c in options}

    def partitions(self) -> list[MeshFile]:
        """A partition for each file below the folder whose name is hemi.file, and whose keys are wanted. No file is opened."""
        fs, path = file_system(self.folder)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=True)):
            hemi, _, rest = info.base_name.partition(".")
            if info.type != pafs.FileType.File or hemi not in ("lh", "rh") or not fnmatch.fnmatchcase(rest, self.pattern):
                continue
            folders = info.path.split("/")[:-1]
            subject = folders[-2] if folders[-1] == "surf" and len(folders) > 1 else folders[-1]
            if all(value in self.wanted.get(c, {value}) for c, value in (("subject", subject), ("hemi", hemi))):
                out.append(MeshFile(info.path, subject, hemi))
        return sorted(out, key=lambda p: p.uri)

    def read(self, partition: MeshFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, MeshFile):  # no file is wanted
            return
        fs, _ = file_system(self.folder)
        with fs.open_input_file(partition.uri) as f:
            raw = f.read()
        try:
            columns = KINDS[self.kind][1](raw)
        except ValueError as e:
            raise ValueError(f"{partition.uri}: {e}") from e
        n = len(next(iter(columns.values())))
        yield pa.RecordBatch.from_pydict({"subject": pa.array([partition.subject] * n, pa.string()), "hemi": pa.array([partition.hemi] * n, pa.string()), **{c: pa.array(v) for c, v in columns.items()}})


class FilteringReader(MeshReader):
    """For sessions that push filters; others refuse a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Equality and IN on the keys choose files; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in KEY:
                values = set(f.value if isinstance(f, In) else [f.value])
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # where each lies, where it goes


class MeshWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.folder, self.kind, self.file, self.overwrite = options["path"], options["kind"], options["file"], overwrite
        if self.kind not in WRITABLE:
            raise ValueError(f"files of kind {self.kind!r} can't be written; there are {', '.join(WRITABLE)}")
        if lost := [c for c in (*KEY, *WRITABLE[self.kind][0]) if c not in schema.names]:
            raise ValueError(f"rows lack {', '.join(lost)}")
        self.names = schema.names
        self.staging = f"{file_system(self.folder)[1]}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        fs, top = file_system(self.folder)
        done, seen = [], set()
        for (subject, hemi), rows in groupby(iterator, key=lambda r: (r["subject"], r["hemi"])):
            if (subject, hemi) in seen:
                raise ValueError(f"rows of {subject}/{hemi} don't stand together; use save()")
            seen.add((subject, hemi))
            raw = WRITABLE[self.kind][1](pd.DataFrame([tuple(r) for r in rows], columns=self.names))
            at = f"{self.staging}/{uuid.uuid4().hex}"
            fs.create_dir(self.staging, recursive=True)
            with fs.open_output_stream(at) as out:
                out.write(raw)
            done.append((at, f"{top}/{subject}/{hemi}.{self.file}"))
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        """Name the files. Two tasks with rows of one mesh, or files that are there and may not be replaced, end the write before any file is named."""
        fs, _ = file_system(self.folder)
        moves = [x for m in messages if m is not None for x in m.files]
        targets = [t for _, t in moves]
        there = [] if self.overwrite or not targets else [i.path for i in fs.get_file_info(targets) if i.type != pafs.FileType.NotFound]
        if there or len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError(f"{there[0]} is there already" if there else "rows of one mesh come from two tasks; use save()")
        for folder in sorted({t.rpartition("/")[0] for t in targets}):
            fs.create_dir(folder, recursive=True)
        for at, target in moves:
            fs.move(at, target)
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """Whatever tasks have left, also those that failed and sent no message."""
        fs, _ = file_system(self.folder)
        if fs.get_file_info(self.staging).type != pafs.FileType.NotFound:
            fs.delete_dir(self.staging)


class MeshFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in KINDS:
            raise ValueError(f"option kind is one of {', '.join(KINDS)}, not {kind!r}")
        return "subject string, hemi string, " + KINDS[kind][0]

    def reader(self, schema: StructType) -> MeshReader:
        kind = FilteringReader if self.options.get("pushdown", "false").lower() == "true" else MeshReader
        return kind(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> MeshWriter:
        return MeshWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(MeshFiles)


def load(spark: SparkSession, folder: str, kind: str, file: str = "*", **keys: str) -> DataFrame:
    """Rows of all files hemi.`file` below a folder; keys: subject, hemi to confine it to."""
    register(spark)
    return spark.read.format(FORMAT).options(kind=kind, file=file, pushdown=spark.conf.get(PUSHDOWN, "false"), **keys).load(folder)


def save(df: DataFrame, folder: str, kind: str, file: str, *, overwrite: bool = False) -> None:
    """folder/subject/hemi.file of each mesh; all of them or none. A mesh's rows are brought together by one shuffle."""
    register(df.sparkSession)
    own = df.select(*KEY, *WRITABLE[kind][0]) if kind in WRITABLE else df
    own.repartition(*KEY).sortWithinPartitions(*KEY).write.format(FORMAT).options(kind=kind, file=file).mode("overwrite" if overwrite else "append").save(folder)

