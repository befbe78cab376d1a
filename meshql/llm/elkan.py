"""Vector code compression: product codes by Lloyd rounds with Elkan's bounds, in integers.

A vector is cut into parts, each with a codebook of its own. Between rounds a table in the shared folder holds, for every part of every vector, its entry, an upper bound of the
distance to it and one lower bound for each entry. A round shifts the bounds by how far the entries have moved, and leaves out an entry if a bound shows that it is strictly
farther; the rest is measured in integers, with ties to the lower index. So codes are those of the plain rounds.

Bounds are kept as the upper halves of 32-bit floats, rounded away from the distance, which costs 1 % of sharpness and half of the space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .shared import cut, new_folder, remove, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer component by amount; what is larger is held there, so that sums of squares fit in 64 bits.
LARGEST = 1 << 26
#: Up to so many labels their sums are broadcast.
BROADCAST_LABELS = 100_000
#: Relative errors of a square root of an exact integer and of the sums of bounds, with a wide margin.
SLACK = 1e-12


def down(x: np.ndarray) -> np.ndarray:
    """x >= 0 as the upper half of a 32-bit float that is x at most."""
    return ((x * (1 - 2.0**-22)).astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def up(x: np.ndarray) -> np.ndarray:
    """x >= 0 as the upper half of a 32-bit float that is x at least."""
    return down(x * (1 + 2.0**-20)) + np.uint16(1)


def wide(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """What is known of the parts of a run of vectors: own (n, parts), high (n, parts) and low (n, parts, entries)."""

    def __init__(self, own: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        self.own, self.high, self.low = own, high, low

    @classmethod
    def none(cls, n: int, parts: int, entries: int) -> Bounds:
        return cls(np.zeros((n, parts), np.uint8), np.full((n, parts), 0x7F80, np.uint16), np.zeros((n, parts, entries), np.uint16))

    @classmethod
    def read(cls, blobs: pa.Array, parts: int, entries: int) -> Bounds:
        n = len(blobs)
        raw = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(n, -1)
        bounds = np.ascontiguousarray(raw[:, parts:]).view(np.uint16).reshape(n, parts, 1 + entries)
        return cls(raw[:, :parts].copy(), bounds[:, :, 0].copy(), bounds[:, :, 1:].copy())

    def blobs(self) -> pa.Array:
        n = len(self.own)
        bounds = np.concatenate([self.high[:, :, None], self.low], axis=2).reshape(n, -1)
        raw = np.concatenate([self.own, np.ascontiguousarray(bounds).view(np.uint8).reshape(n, -1)], axis=1)
        return pa.array([x.tobytes() for x in raw], pa.binary())


def assign(x: np.ndarray, books: np.ndarray, moved: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, int]:
    """Move every part of x (n, parts, length) to its nearest entry of books (parts, entries, length), and bring the bounds up to it.

    moved (parts, entries): how far the entries have moved since. Returns the squared distances (n, parts), -1 where they weren't needed, and the number of distances taken.
    """
    n, parts, _ = x.shape
    exact, taken = np.full((n, parts), -1, np.int64), 0
    for p in range(parts):
        book, own = books[p], bounds.own[:, p].astype(np.int64)
        apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(axis=2)) * (0.5 * (1 - SLACK))
        low = np.maximum(0, wide(bounds.low[:, p]) - moved[p] * (1 + SLACK)) * (1 - SLACK)
        high = (wide(bounds.high[:, p]) + moved[p][own] * (1 + SLACK)) * (1 + SLACK)

        def open_(rows: np.ndarray, own=own, high=high, low=low, apart=apart) -> np.ndarray:  # noqa: ANN001
            at = own[rows]
            far = high[rows, None]
            out = ~((far < low[rows]) | (far < apart[at]))
            out[np.arange(len(rows)), at] = False
            return out

        rows = np.arange(n)
        rows = rows[open_(rows).any(axis=1)]
        exact[rows, p] = squares(x[rows, p], book[own[rows]])
        taken += len(rows)
        root = np.sqrt(exact[rows, p])
        high[rows] = root * (1 + SLACK)
        low[rows, own[rows]] = root * (1 - SLACK)
        left = open_(rows)
        best, entry = exact[rows, p].copy(), own[rows].copy()
        for j in range(len(book)):
            some = np.flatnonzero(left[:, j])
            d = squares(x[rows[some], p], book[j])
            taken += len(some)
            low[rows[some], j] = np.sqrt(d) * (1 - SLACK)
            nearer = (d < best[some]) | ((d == best[some]) & (j < entry[some]))
            best[some[nearer]], entry[some[nearer]] = d[nearer], j
        exact[rows, p] = best
        high[rows] = np.sqrt(best) * (1 + SLACK)
        bounds.own[:, p], bounds.high[:, p], bounds.low[:, p] = entry_into(bounds.own[:, p], rows, entry), up(high), down(low)
    return exact, taken


def entry_into(own: np.ndarray, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    out = own.copy()
    out[rows] = entry
    return out


def sums(x: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """(parts, entries, 1 + length): count and componentwise sums of the parts at each entry."""
    n, parts, length = x.shape
    out = np.zeros((parts, entries, 1 + length), np.int64)
    for p in range(parts):
        out[p, :, 0] = np.bincount(own[:, p], minlength=entries)
        np.add.at(out[p, :, 1:], own[:, p], x[:, p])
    return out


STATE = "vec_id long, label string, x binary, bounds binary, sums binary"
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _integers(width: int):  # noqa: ANN202
    """Rows of the kept vectors as packed 32-bit integers; shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            size = np.diff(v.offsets.to_numpy())
            x = np.zeros((len(v), width))
            x[np.arange(width) < size[:, None]] = v.flatten().to_numpy()
            x = np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.nulls(len(v), pa.binary()), pa.nulls(len(v), pa.binary())], STATE_NAMES)

    return run


def _unpacked(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).astype(np.int64).reshape(batch.num_rows, parts, -1)


def _round(books: np.ndarray, moved: np.ndarray):  # noqa: ANN202
    """Assign a task's rows and write their new bounds; at the end a row with the task's sums."""
    parts, entries, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + length), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, old = _unpacked(batch, parts), batch.column("bounds")
            bounds = Bounds.none(len(x), parts, entries) if old.null_count else Bounds.read(old, parts, entries)
            assign(x, books, moved, bounds)
            total += sums(x, bounds.own, entries)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), bounds.blobs(), pa.nulls(len(x), pa.binary())], STATE_NAMES)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([None], t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary())] + [pa.array([total.tobytes()], pa.binary())], STATE_NAMES)

    return run


def _codes(books: np.ndarray, moved: np.ndarray):  # noqa: ANN202
    """The last assignment: code and error of every row. Distances that the bounds spared are taken now."""
    parts, entries, _ = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, old = _unpacked(batch, parts), batch.column("bounds")
            bounds = Bounds.none(len(x), parts, entries) if old.null_count else Bounds.read(old, parts, entries)
            exact, _ = assign(x, books, moved, bounds)
            for p in range(parts):
                rows = np.flatnonzero(exact[:, p] < 0)
                exact[rows, p] = squares(x[rows, p], books[p][bounds.own[rows, p]])
            code = pa.array([r.tobytes().hex() for r in bounds.own], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(exact.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def _summed(width: int):  # noqa: ANN202
    """The sums of a run of tasks put together, so that what comes to the driver doesn't grow with their number."""

    def run(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for blob in group["sums"]:
            total += np.frombuffer(blob.as_buffer(), np.int64)
        return pa.table({"g": group["g"].slice(0, 1).combine_chunks(), "sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _total(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of a round, in two steps: a task adds up those of about a thousand tasks at most."""
    width, found = int(np.prod(shape)), state.where("sums is not null").select("sums")
    for spread in (F.pmod(F.xxhash64("sums"), F.lit(64)), F.lit(0).cast("long")):
        found = found.select(spread.alias("g"), "sums").groupBy("g").applyInArrow(_summed(width), "g long, sums binary").select("sums")
    row = found.first()
    return np.frombuffer(bytes(row["sums"]), np.int64).reshape(shape) if row else np.zeros(shape, np.int64)


def kept_vectors(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector has no null or non-finite component, and isn't null."""
    v = F.col(column).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~odd).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), v.alias("v"))


def codebooks(kept: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The trained books (parts, entries, length), how far their entries moved in the last update, and the table of rows with their bounds before that update."""
    spark = kept.sparkSession
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-width // parts)) * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # one vector an entry
    x = np.zeros((len(first), width))
    for i, r in enumerate(first):
        x[i, : len(r["v"])] = r["v"]
    books = np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    state = kept.mapInArrow(K.tidy(_integers(width)), STATE)
    moved, old = np.zeros(books.shape[:2]), ""
    if not len(first):
        return books, moved, state
    for _ in range(rounds):
        folder = new_folder(spark, "bounds")
        state.where("sums is null").mapInArrow(K.tidy(_round(books, moved)), STATE).write.parquet(folder)
        state = spark.read.schema(STATE).parquet(folder)
        if old:
            remove(old)  # the rounds before aren't read again
        old = folder
        total = _total(state, (*books.shape[:2], 1 + books.shape[2]))
        count = total[:, :, :1]
        fresh = np.where(count > 0, total[:, :, 1:] // np.maximum(1, count), books)
        moved = np.sqrt(((fresh - books) ** 2).sum(axis=2))
        books = fresh
    return books, moved, state.where("sums is null")


def product_codes(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector without null or non-finite components.

    Components become floor(4096 * x); `parts` codebooks start as the parts of the vectors with the `entries` smallest ids (ties by the vectors themselves; a null id counts as the
    largest and stays null) and are trained for `rounds` rounds on all rows. Fewer rows than entries give as many entries. Vectors shorter than the longest, or than a multiple of
    the parts, are filled up with zeros, empty ones too; components beyond 2**14 are held there. Repeated rows count and return each. No rows, or none kept, give no rows; other
    columns are left out. label_error sums the error over equal labels, null among them.
    """
    kept = kept_vectors(vectors, id_column=id_column, column=column, label_column=label_column)
    books, moved, state = codebooks(kept, parts=parts, entries=entries, rounds=rounds)
    coded = cut(state.mapInArrow(K.tidy(_codes(books, moved)), "vec_id long, label string, code string, error long"))
    by_label = cut(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(F.col("label").alias("_label"), F.least("sum", F.lit(2**63 - 1)).cast("long").alias("label_error")))
    if by_label.count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    digest = F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Plain rounds: every distance of every round, one statement for each round."""
    out = [
        f"""WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, len(v) // {PARTS} AS m FROM k
), x AS MATERIALIZED (
  SELECT rid, part, v[part * m + 1 : (part + 1) * m] AS v FROM n, range({PARTS}) t(part)
), c0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, v AS c FROM x WHERE rid <= {ENTRIES}
)"""
    ]
    for i in range(ROUNDS + 1):
        out.append(
            f"""a{i} AS MATERIALIZED (
  SELECT rid, part, min({{'d': d, 'entry': entry}}) AS best FROM (
    SELECT rid, x.part, entry, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{i} ON x.part = c{i}.part
  ) GROUP BY rid, part
)"""
        )
        if i < ROUNDS:
            out.append(
                f"""s{i} AS (
  SELECT part, entry, list(CAST(s - ((s % q) + q) % q AS BIGINT) // q ORDER BY place) AS c FROM (
    SELECT part, entry, place, sum(value)::BIGINT AS s, count(*) AS q
    FROM (SELECT a{i}.part, best.entry AS entry, unnest(v) AS value, generate_subscripts(v, 1) AS place FROM a{i} JOIN x USING (rid, part)) GROUP BY ALL
  ) GROUP BY ALL
), c{i + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (part, entry)
)"""
            )
    last = ROUNDS
    return ", ".join(out) + f"""
, e AS (
  SELECT rid, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY rid
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, entry) FROM c{last})) AS codebooks_sha256
FROM e JOIN n USING (rid)"""


ORACLE = _oracle()
