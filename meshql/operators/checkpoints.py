"""The folder that driver and executors share: lineage cut there, and files that tasks read."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, as in tests, a temporary one is made on a local master; elsewhere that is an error."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(remove, "file://" + folder)
        place = "file://" + folder
        sc.setCheckpointDir(place)
    return place


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Up to so many rows of vertices, faces or edges a join may send to all tasks, some 100 bytes a row.
BROADCAST_ROWS = 200_000


def unsent(rows: DataFrame, n: int) -> DataFrame:
    """A table of n rows, marked so that no join sends it through the driver to all tasks if they are many.

    The planner takes a table's size from its files, in which ids, runs of numbers and names are packed to a byte or less; the rows that a join would send take a hundred times as much. The mark holds
    for what is selected or grouped from the table, too; joins by mesh alone name the side that is sent themselves.
    """
    return rows.hint("merge") if n > BROADCAST_ROWS else rows


def kept(df: DataFrame) -> DataFrame:
    """The same as settled(), as a table: for what a loop makes anew from itself.

    A checkpoint hands on its plan's estimate of the size, which for a join is the product of both sides', so that a table joined with itself in each round has an estimate
    of twice as many digits each time, and the planner ends in long multiplication. A table's size is that of its files, see unsent().
    """
    uri = new_folder(df.sparkSession, "rounds")
    df.write.parquet(uri)
    out = df.sparkSession.read.schema(df.schema).parquet(uri)
    return unsent(out, out.count())  # from the files' footers


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in the shared folder, which is removed when the driver ends."""
    uri = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, uri)
    return uri


def remove(uri: str) -> None:
    """Delete a folder; one that is gone or can't be deleted is left."""
    try:
        fs, path = pafs.FileSystem.from_uri(_uri(uri))
        fs.delete_dir(path)
    except (OSError, ValueError):
        pass


def _uri(place: str) -> str:
    return place if "://" in place or not place.startswith("/") and ":" in place else "file://" + os.path.abspath(place)


def file_system(place: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it without a slash at its end."""
    fs, path = pafs.FileSystem.from_uri(_uri(place))
    return fs, path.rstrip("/")


def write_file(uri: str, data: bytes | memoryview) -> None:
    """Write a whole file; a task that is run again leaves the same content, never half a file."""
    fs, path = pafs.FileSystem.from_uri(_uri(uri))
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def map_file(uri: str) -> pa.Buffer | None:
    """The file memory-mapped; where the shared folder isn't mounted, read into memory. None if there is no such file."""
    fs, path = pafs.FileSystem.from_uri(_uri(uri))
    if isinstance(fs, pafs.LocalFileSystem):
        if not os.path.exists(path):
            return None
        return pa.memory_map(path).read_buffer() if os.path.getsize(path) else pa.py_buffer(b"")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return f.read_buffer()
