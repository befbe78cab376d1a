"""MinHash near-duplicates: circulant signatures, bands, and exact Jaccard verification.

All coordinates of a signature come from two permutations of the places 0 to 2**PLACES - 1. The first scatters an n-gram's hash; the second, a table of ranks,
is shifted by one place for each coordinate and starts again at its end, so that coordinate k of a set is the smallest rank found k places after its n-grams'.
The ranks of an n-gram for all coordinates thus stand side by side in the table, and a signature is the smallest of the rows of a set.

Sets with a band of coordinates in common meet in a list. The lists are an aggregate and a join (no list is held by one task); what is in them is confirmed, and joined up
to components, by the steps of the n-gram Jaccard join. Lists whose sets are all connected after the comparison with the list's hub are dropped before any pair
is looked at; long lists that aren't are dealt by pairs of their parts, and their pairs are held against bitmaps of the sets, an exact upper bound of what two sets
share, before any text is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from . import textkit as K
from .jaccard import prints, sets
from .shared import cut, table

WORDS, PERCENT = 5, 85
#: Coordinates are BANDS * ROWS. Two sets at the threshold share no band with probability (1 - 0.85**5)**24, below one in a million.
BANDS, ROWS = 24, 5
#: Places of the permutations: 2**22, a table of 16 MB a worker.
PLACES, SEED = 22, 20
#: N-grams whose rows of ranks are held at once, and sets of a list's part.
STEP, PART = 1 << 15, 2048
#: Entries of lists for each task that looks for open pairs, before lists without any are dropped.
ENTRIES = 1 << 16
U64 = np.uint64

_ranks: dict[tuple[int, int], np.ndarray] = {}


def scatter(keys: np.ndarray) -> np.ndarray:
    """The first permutation: places of 64-bit hashes, by odd multipliers and a shift that are one to one on the places."""
    low = U64((1 << PLACES) - 1)
    x = keys >> U64(64 - PLACES)
    x = (x * U64(0x2545F491)) & low
    x = x ^ (x >> U64(PLACES // 2))
    return ((x * U64(0x9E3779B1)) & low).astype(np.int64)


def ranks(coordinates: int) -> np.ndarray:
    """The second permutation, with its first places repeated at the end for the shifts."""
    at = (PLACES, coordinates)
    if at not in _ranks:
        _ranks.clear()
        order = np.random.default_rng(SEED).permutation(1 << PLACES).astype(np.uint32)
        _ranks[at] = np.concatenate([order, order[:coordinates]])
    return _ranks[at]


def signatures(rows: np.ndarray, keys: np.ndarray, n: int, coordinates: int) -> np.ndarray:
    """The signatures (n, coordinates) of n sets of n-gram hashes, given by (row, hash) in the order of rows. An empty set has the largest number throughout."""
    shifted = np.lib.stride_tricks.sliding_window_view(ranks(coordinates), coordinates)
    out = np.full((n, coordinates), np.iinfo(np.uint32).max, dtype=np.uint32)
    at = scatter(keys)
    for a in range(0, len(at), STEP):
        own = rows[a : a + STEP]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(shifted[at[a : a + STEP]], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def bands(signature: np.ndarray, count: int) -> np.ndarray:
    """(n, count) hashes of the signatures' bands; the band's number is part of it."""
    n, coordinates = signature.shape
    parts = signature.reshape(n, count, coordinates // count).astype(U64)
    out = np.broadcast_to(K.mix(np.arange(1, count + 1, dtype=U64)), (n, count))
    for i in range(parts.shape[2]):
        out = K.mix(out * U64(3) + parts[:, :, i])
    return out


def _signed(words: int, count: int, per: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                rows, keys = sets(data, offsets, words)
                size, fp = prints(rows, keys, b - a)
                tokens = bands(signatures(rows, keys, b - a, count * per), count).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * count, count, dtype=np.int32)), pa.array(tokens.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), pa.array(size), pa.array(fp.view(np.int64)), lists], ["doc", "n", "fp", "bands"])

    return run


def band_lists(signed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists (jaccard.LISTS) of the different sets that share a band, and (token, hub, hub_n): the set with the least hash of each list, found by a partial aggregate.

    pair: the sizes allow a link with the hub.
    """
    sets_of = signed.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    entries = sets_of.select("fp", "n", F.explode("bands").alias("token"))
    lead = F.min(F.struct(F.xxhash64("fp").alias("h"), "fp", "n"))
    # settled, so that both sides of the join are shuffled for it and a token that many sets have can be split
    hubs = cut(entries.groupBy("token").agg(lead.alias("lead"), F.count("*").alias("c")).where("c > 1").select("token", F.col("lead.fp").alias("hub"), F.col("lead.n").alias("hub_n")))
    # the smallest overlap of a link is at most the smaller set
    fits = F.ceil((F.col("n") + F.col("hub_n")) * percent / (100 + percent)) <= F.least("n", "hub_n")
    zero = F.lit(0)
    return entries.join(hubs, "token").select(zero.alias("shard"), "token", "fp", "n", zero.cast("long").alias("place"), "hub", "hub_n", ((F.col("fp") != F.col("hub")) & fits).alias("pair")), hubs


def open_lists(mixed: DataFrame, hubs: DataFrame, led: DataFrame, shards: int) -> DataFrame:
    """Of the lists' entries those of lists with sets of several components, dealt by neighbourhood: lists whose hubs stand with one set go to one shard, where a pair
    that meets in many of them is found once. A neighbourhood of over PART sets goes as pairs of parts: each entry to the pairs that hold its part."""
    many = mixed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).where("low < high").select("token", "c")
    placed = cut(many.join(hubs.select("token", "hub"), "token").join(led.select(F.col("fp").alias("hub"), "lead"), "hub").select("token", "lead", "c"))
    total = placed.groupBy("lead").agg(F.ceil(F.sum("c") / (BANDS * PART)).alias("parts"))
    placed = cut(placed.join(total, "lead").select("token", "lead", "parts"))
    own = mixed.drop("shard").join(placed, "token").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    held = pairs.withColumn("shard", F.pmod(F.xxhash64("lead", low, high), F.lit(shards)).cast("int")).withColumn("token", F.when(F.col("parts") == 1, F.col("token")).otherwise(F.xxhash64("token", low, high)))
    return held.drop("part", "other", "parts", "lead")


def with_sketches(entries: DataFrame, drawn: DataFrame) -> DataFrame:
    """Entries of lists, and for each shard a row with the sketch of every set that it has, from drawn (fp, bits): texts travel only for pairs that their sketches don't rule out."""
    entries = cut(entries)
    return entries.unionByName(entries.select("shard", "fp").distinct().join(drawn, "fp"), allowMissingColumns=True)


def near_duplicates(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, count: int = BANDS, per: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; the smallest doc_id of a component is kept.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct n-word shingles (A-Z lower-cased, words parted by white space), which is
    checked on the full sets of the pairs that share one of `count` bands of `per` coordinates. A text with fewer words is one shingle as a whole; null, empty and
    blank texts have an empty set and no links. component_id is the smallest doc_id reachable by links. A null doc_id counts as the largest and stays null where no
    other is reached; such a row is kept. Repeated rows link with each other, and all with the smallest doc_id are kept. Very long texts are taken whole, in steps. No
    rows give no rows; other columns are left out. Sets are told apart by 64-bit hashes.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), "text")
    signed = cut(base.mapInArrow(K.tidy(_signed(words, count, per)), "doc long, n long, fp long, bands array<long>"))
    lists, hubs = band_lists(signed, percent)
    lists = cut(lists)
    shards = max(64, lists.count() // ENTRIES)
    found = jaccard.linked_components(base, signed.drop("bands"), lists, lambda mixed, led, drawn: with_sketches(open_lists(mixed, hubs, led, shards), drawn), words, percent, drawn=True)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = f"SELECT *, doc_id = component_id AS kept FROM ({jaccard.ORACLE.replace('100 * o >= 80 *', '100 * o >= 85 *')})"
