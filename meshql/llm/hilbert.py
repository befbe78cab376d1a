"""Sharding along a Hilbert curve over quantised metadata, so that files can be pruned on several columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc, cut, table

#: Bits of each of the four dimensions.
BITS = 8


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of axes (n, dims), every coordinate under 2**bits; dims * bits <= 63.

    Works from the top bit down on all rows at once: undo the reflections and exchanges of the enclosing cubes, then
    Gray-decode across the dimensions and interleave the bits.
    """
    x = [np.asarray(axes[:, d], dtype=np.int64).copy() for d in range(axes.shape[1])]
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for d in range(len(x)):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros(len(x[0]), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    out = np.zeros(len(x[0]), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            out = (out << 1) | (((x[d] ^ turn) >> b) & 1)
    return out


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        axes = np.stack([batch.column(f"q_{d}").to_numpy(zero_copy_only=False) for d in ("len", "lang", "source", "id")], axis=1)
        yield batch.append_column("hilbert", pa.array(hilbert_index(axes, BITS), pa.int64()))


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deal documents into runs of the Hilbert curve whose row counts are at most one apart (law `rows`).

    Dimensions: the logarithm of the size, the crc32 of lang and of source (equal values share a bucket, so that an
    equality test on the q_ columns prunes files), and doc_id between its least and largest value. Returns doc_id, size (UTF-8 bytes + 1),
    text_crc32, law, shard, slot (gapless from 0 inside its shard), grown_shard (null), hilbert and the q_ columns.

    Null texts have size 1 and the crc32 of an empty one; null lang, source and doc_id have bucket 0. Ties on the curve go
    by doc_id, size and text_crc32; equal rows get neighbouring slots. No rows give no rows; other columns are left out.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    width = max(1, (high or 0) - (low or 0) + 1)
    top = (1 << BITS) - 1
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc(F.col("text")).alias("text_crc32"),
        F.least(F.lit(top), F.floor(F.log2(size.cast("double")) * 8)).cast("int").alias("q_len"),
        *[F.coalesce(crc(F.col(c)) % (top + 1), F.lit(0)).cast("int").alias(f"q_{c}") if c in docs.columns else F.lit(0).alias(f"q_{c}") for c in ("lang", "source")],
        F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)).cast("double") * (top + 1) / F.lit(float(width))), F.lit(0)).cast("int").alias("q_id"),
    ).withColumn("q_id", F.least(F.lit(top), F.col("q_id")))
    schema = "doc_id long, size long, text_crc32 long, q_len int, q_lang int, q_source int, q_id int, hilbert long"
    keys = ["hilbert", "doc_id", "size", "text_crc32"]
    parts = max(docs.rdd.getNumPartitions(), shards)
    # ranged and sorted once and kept: a row's place in its partition is then its rank less the rows of earlier partitions
    ranged = cut(keyed.mapInArrow(_indexed, schema).repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    counts = ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one row for each partition
    before, total = {}, 0
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        before[p], total = total, total + n
    offsets = docs.sparkSession.createDataFrame(list(before.items()), "_p int, _before long")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = ranged.withColumns({"_p": F.spark_partition_id(), "_row": row}).join(F.broadcast(offsets), "_p")
    out = ranged.withColumn("_place", F.col("_before") + F.col("_row")).withColumn("shard", F.expr(f"cast((_place * {shards}) div {max(1, total)} as int)"))
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "hilbert", "q_len", "q_lang", "q_source", "q_id",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
