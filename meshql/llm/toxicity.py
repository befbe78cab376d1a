"""Toxicity by class-conditional Kneser-Ney models: toxic against ordinary log-likelihood, length-normalised.

The models spell words letter by letter (bytes of UTF-8). Each class has its own counts for full contexts; where a
class has seen a context rarely or never, both classes back off to the same continuation counts, pooled over the classes, so that a rare
expression counts for a class only as far as its letters in context tell. A word's log-likelihood ratio depends on the word alone; a
document's features are means of it over windows of several lengths, and a logistic curve fitted on labelled
documents that the counts haven't seen maps them to a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .shared import crc, table

#: Letters of an n-gram, the last one included.
ORDER = 5
#: Lengths in words of the windows whose best mean is a feature, besides the whole text's mean.
WINDOWS = (1, 3, 10)
#: Bounds on the labelled ordinary and toxic documents that the classifier is fitted on.
MAX_DOCS = (4000, 2000)
#: predicted is 1 from this score on.
THRESHOLD = 0.7
#: Words whose ratio a worker keeps at hand, a power of two. Only speed depends on it.
CACHE = 1 << 20

#: Letters are a-z, A-Z and all bytes of longer UTF-8 sequences; the rest parts words.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
START, END = b"\x02", b"\x03"


def _find(keys: np.ndarray, values: list[np.ndarray], defaults: list[float], wanted: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [np.full(len(wanted), d) for d in defaults]
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    hit = keys[at] == wanted
    return [np.where(hit, v[at], d) for v, d in zip(values, defaults, strict=True)]


def _spread(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of marked words: the places of all letters but the start marks, the start of each one's full context, its word."""
    words = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    places = np.flatnonzero(np.arange(len(flat)) != offsets[words])
    words = words[places]
    return places, np.maximum(offsets[words], places - ORDER + 1), words


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return once / (once + 2 * twice) if once and twice else 0.5


class KneserNeyPair:
    """Two interpolated Kneser-Ney models over letters with a shared backoff, as sorted hash arrays.

    words: distinct words without marks; counts: (n, 2) how often each occurs in ordinary and in toxic documents.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray) -> None:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths)
        flat, offsets = K.gather(np.frombuffer(b"".join(words), dtype=np.uint8), ends - lengths, ends, START, END)
        places, begin, word = _spread(flat, offsets)
        grams, at = np.unique(K.span_hashes(flat, begin, places + 1), return_inverse=True)
        contexts, of = np.unique(K.span_hashes(flat, begin, places), return_inverse=True)
        first = np.zeros(len(grams), dtype=np.int64)
        first[at] = of  # the context of each n-gram
        gained, weight = [], []
        for k in (0, 1):
            n = np.bincount(at, counts[word, k], len(grams)) if len(places) else np.zeros(0)
            d = _discount(n)
            total = np.bincount(first, n, len(contexts))
            kinds = np.bincount(first, n > 0, len(contexts))
            safe = np.maximum(total, 1)
            gained.append(np.maximum(n - d, 0) / safe[first] if len(n) else n)
            weight.append(np.where(total > 0, d * kinds / safe, 1.0))
        slim = [x.astype(np.float32) for x in gained], [x.astype(np.float32) for x in weight]
        self.top = (grams, slim[0], contexts, slim[1])
        # shared lower orders: in how many ways, over both classes, an n-gram is continued to the left
        self.lower = []
        for size in range(1, ORDER):
            held = places - size >= begin
            end = places[held] + 1
            _, one = np.unique(K.span_hashes(flat, end - size - 1, end), return_index=True)
            end = end[one]
            keys, inv, n = np.unique(K.span_hashes(flat, end - size, end), return_inverse=True, return_counts=True)
            ctx, of = np.unique(K.span_hashes(flat, end - size, end - 1), return_inverse=True)
            first = np.zeros(len(keys), dtype=np.int64)
            first[inv] = of
            d = _discount(n)
            total = np.bincount(first, n, len(ctx))
            gain, back = np.maximum(n - d, 0) / np.maximum(total, 1)[first], d * np.bincount(first, minlength=len(ctx)) / np.maximum(total, 1)
            self.lower.append((keys, [gain.astype(np.float32)], ctx, [back.astype(np.float32)]))

    def ratios(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of marked words."""
        places, begin, word = _spread(flat, offsets)
        grams, gained, contexts, weight = self.top
        ordinary, toxic = _find(contexts, weight, [np.nan, np.nan], K.span_hashes(flat, begin, places))
        seen = ~np.isnan(ordinary)  # an unseen context is the same backoff for both classes
        places, begin, word, ordinary, toxic = places[seen], begin[seen], word[seen], ordinary[seen], toxic[seen]
        p = np.full(len(places), 1 / 256)
        for size, (keys, share, ctx, back) in enumerate(self.lower, 1):
            held = np.flatnonzero(places - size >= begin)
            end = places[held] + 1
            (gamma,) = _find(ctx, back, [1.0], K.span_hashes(flat, end - size, end - 1))
            (gain,) = _find(keys, share, [0.0], K.span_hashes(flat, end - size, end))
            p[held] = gain + gamma * p[held]
        a, b = _find(grams, gained, [0.0, 0.0], K.span_hashes(flat, begin, places + 1))
        each = np.log(b + toxic * p) - np.log(a + ordinary * p)
        return np.bincount(word, each, len(offsets) - 1)


class Scorer:
    """Features of texts; keeps the ratios of words between chunks in a direct-mapped table."""

    def __init__(self, pair: KneserNeyPair) -> None:
        self.pair = pair
        self.keys, self.values = np.zeros(CACHE, dtype=np.uint64), np.zeros(CACHE, dtype=np.float32)

    def word_ratios(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = K.span_hashes(flat, starts, ends)
        slot = (hashes & np.uint64(CACHE - 1)).astype(np.int64)
        out = self.values[slot].astype(float)
        new = np.flatnonzero(self.keys[slot] != hashes)
        if len(new):
            keys, first, inv = np.unique(hashes[new], return_index=True, return_inverse=True)
            ratios = self.pair.ratios(*K.gather(flat, starts[new[first]], ends[new[first]], START, END))
            out[new] = ratios[inv]
            place = (keys & np.uint64(CACHE - 1)).astype(np.int64)
            self.keys[place], self.values[place] = keys, ratios
        return out

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, 1 + windows): mean ratio of the whole text, best mean over its windows of each length."""
        low = K.fold(data)
        starts, ends, bounds = K.word_spans(low, offsets, NOT_LETTER)
        ratios = self.word_ratios(low, starts, ends)
        count = np.diff(bounds)
        total = np.concatenate([[0.0], np.cumsum(ratios)])
        out = np.zeros((len(count), 1 + len(WINDOWS)))
        out[:, 0] = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(count, 1)
        rows = np.flatnonzero(count > 0)
        if len(rows):
            for i, w in enumerate(WINDOWS, 1):
                at = np.arange(len(ratios))
                end = np.minimum(at + w, np.repeat(bounds[1:], count))  # a window at the text's end is shorter
                mean = (total[end] - total[at]) / w
                out[rows, i] = np.maximum.reduceat(mean, bounds[:-1][rows])
        return out


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (bias last), mean and scale of a ridge logistic regression with balanced classes, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (share * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of each class in a batch."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, offsets in K.chunks(batch.column("text")):
            low = K.fold(data)
            starts, ends, bounds = K.word_spans(low, offsets, NOT_LETTER)
            kind = np.repeat(toxic[a:b], np.diff(bounds))
            _, first, inv = np.unique(K.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
            words = [low[s:e].tobytes() for s, e in zip(starts[first], ends[first], strict=True)]
            n = [pa.array(np.bincount(inv, kind == k, len(first)).astype(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *n], ["word", "n0", "n1"])


def _featured(pair: KneserNeyPair, docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and the features of docs, whose texts are a column or a field of the struct row."""
    from pyspark.sql.types import StructType

    names = [f"_x{i}" for i in range(1 + len(WINDOWS))]
    shared = docs.sparkSession.sparkContext.broadcast(pair)  # as large as the bounded sample's letters make it
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(", ".join(f"{c} double" for c in names)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            text = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("row"), "text")
            for a, b, data, offsets in K.chunks(text):
                x = scorer.features(data, offsets)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in keep], *map(pa.array, x.T)], [*keep, *names])

    return docs.mapInArrow(K.tidy(run), schema)


class ToxicityModel:
    def __init__(self, pair: KneserNeyPair, logistic: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.pair, self.logistic = pair, logistic

    def score(self, docs: DataFrame) -> DataFrame:
        """(row struct of all columns of docs, score double from 0 to 1, predicted int)."""
        w, mean, scale = self.logistic
        z = F.lit(float(w[-1] - (w[:-1] * mean / scale).sum()))
        for i in range(len(w) - 1):
            z = z + F.lit(float(w[i] / scale[i])) * F.col(f"_x{i}")
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        scored = _featured(self.pair, rows, ["row"]).select("row", (1 / (1 + F.exp(-z))).alias("score"))
        return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, max_docs: tuple[int, int] = MAX_DOCS) -> ToxicityModel:
    """Fit on at most max_docs documents of either class, those first by a hash of doc_id, with whole texts.

    Four fifths of them give the n-gram counts, the others the logistic curve. Labels that are null are left out; of
    several labels of one doc_id the largest holds. Without documents of both classes every score is 0.5.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(max_docs[k]) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("_fit", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) > 0)
    counts = (
        rows.where("_fit").select("toxic", "text").mapInArrow(K.tidy(_words), "word binary, n0 long, n1 long")
        .groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    )
    n = np.column_stack([counts[c].to_numpy() for c in ("n0", "n1")]).astype(float)
    pair = KneserNeyPair(counts["word"].to_pylist(), n.reshape(-1, 2))
    found = _featured(pair, rows.where("not _fit"), ["toxic"]).toArrow()
    x = np.column_stack([found[f"_x{i}"].to_numpy() for i in range(1 + len(WINDOWS))])
    y = found["toxic"].to_numpy()
    flat = np.zeros(x.shape[1])
    logistic = _fit_logistic(x, y) if len(set(y.tolist())) == 2 else (np.append(flat, 0.0), flat, flat + 1)
    return ToxicityModel(pair, logistic)


def held_out() -> Column:
    return crc(F.col("doc_id")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on the labels outside the held-out third."""
    return fit(docs, labels.select("doc_id", "toxic").where(~held_out()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts, and texts without letters, have all features 0 and are scored as such. A null doc_id is never
    labelled; its held_out is that of an empty text. Repeated rows each have a row. No rows give no rows; other columns
    than doc_id and text are never looked at.
    """
    scored = train(docs, labels).score(docs.select("doc_id", "text")).select("row.doc_id", "score", "predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
