"""Language-model scoring: interpolated modified Kneser-Ney over word pairs, counted in Spark, kept as sorted hash
arrays in the shared folder and memory-mapped by the workers that score.

Counting never brings the corpus together in one place. Tasks count the pairs of their own texts and send them to shards
by the hash of the first word; first words that hold more than one 256th of all tokens are told apart by the second
word as well. A shard adds up its pairs, writes them as a sorted array and passes on what it knows of single words,
which a second set of shards adds up and writes in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .shared import crc, map_file, new_folder, sharded, table, write_file

#: Pairs that a task holds before it counts and sends them.
FLUSH = 4_000_000
#: Buckets of first words whose tokens are counted to find the hot ones, and the share of all tokens that makes one hot.
BUCKETS, HOT_SHARE = 1 << 16, 256
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's tokens, each text's words and then one end, and the place of each text's first (n + 1)."""
    low = K.LOWER[data]
    starts, ends, bounds = K.word_spans(low, offsets)
    words = K.span_hashes(low, starts, ends)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def histories(seconds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token; BEGIN before a text's first."""
    out = np.empty_like(seconds)
    out[1:] = seconds[:-1]
    out[bounds[:-1]] = BEGIN
    return out


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return K.mix(first * np.uint64(3) + second)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (K.mix(hashes) >> np.uint64(64 - (shards.bit_length() - 1))).astype(np.int64)


def pair_shard(first: np.ndarray, second: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """A pair goes by its first word, or by both words if the first word's bucket is hot."""
    by_both = hot[(first >> np.uint64(48)).astype(np.int64)]
    return shard_of(np.where(by_both, pair_key(first, second), first), shards)


class _Out:
    """Arrays written one after another, each behind its length. Small counts take a byte."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def put(self, x: np.ndarray) -> _Out:
        pad = -x.nbytes % 8
        self.parts += [np.uint64(len(x)).tobytes(), x.tobytes(), b"\0" * pad]
        return self

    def counts(self, x: np.ndarray) -> _Out:
        large = np.flatnonzero(x > 254)
        small = x.astype(np.uint8)
        small[large] = 255
        return self.put(small).put(large.astype(np.uint32)).put(x[large].astype(np.uint64))

    def bytes(self) -> bytes:
        return b"".join(self.parts)


class _In:
    def __init__(self, raw: bytes | pa.Buffer) -> None:
        self.raw, self.at = raw, 0

    def take(self, kind: type) -> np.ndarray:
        n = int(np.frombuffer(self.raw, np.uint64, 1, self.at)[0])
        out = np.frombuffer(self.raw, kind, n, self.at + 8)
        self.at += 8 + out.nbytes + -out.nbytes % 8
        return out

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.take(np.uint8), self.take(np.uint32), self.take(np.uint64)

    def counts(self) -> np.ndarray:
        small, large, values = self.packed()
        out = small.astype(np.int64)
        out[large] = values
        return out


def _totals(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the place of one entry of each, and the sums of values by key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], order[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _blobs(shards: np.ndarray, number: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its entries in the given order) of every shard that has any."""
    order = np.argsort(shards, kind="stable")
    edges = np.searchsorted(shards[order], np.arange(number + 1))
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), order[edges[s] : edges[s + 1]]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in K.chunks(batch.column("text")):
            firsts = histories(*tokens(data, offsets))
            total += np.bincount((firsts >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])


def _pairs(hot: np.ndarray, shards: int):  # noqa: ANN202
    def flush(firsts: list[np.ndarray], seconds: list[np.ndarray]) -> pa.RecordBatch:
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        _, one, n = _totals(pair_key(first, second), np.ones(len(first), dtype=np.int64))
        first, second = first[one], second[one]
        rows = []
        order = np.argsort(first, kind="stable")
        first, second, n = first[order], second[order], n[order]
        for s, own in _blobs(pair_shard(first, second, hot, shards), shards):
            f = first[own]
            start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            rows.append((s, _Out().put(f[start]).counts(np.diff(np.append(start, len(f)))).put(second[own]).counts(n[own]).bytes()))
        return _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column("text")):
                second, bounds = tokens(data, offsets)
                firsts.append(histories(second, bounds))
                seconds.append(second)
                held += len(second)
                if held >= FLUSH:
                    yield flush(firsts, seconds)
                    firsts, seconds, held = [], [], 0
        if held:
            yield flush(firsts, seconds)

    return run


def _count_counts(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)


def _pair_shards(uri: str, shards: int):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        firsts, seconds, counts = [], [], []
        for blob in group["blob"]:
            read = _In(blob.as_buffer())
            first, each = read.take(np.uint64), read.counts()
            firsts.append(np.repeat(first, each))
            seconds.append(read.take(np.uint64))
            counts.append(read.counts())
        first, second = np.concatenate(firsts), np.concatenate(seconds)
        keys, one, n = _totals(pair_key(first, second), np.concatenate(counts))
        first, second = first[one], second[one]
        write_file(f"{uri}/pairs-{group['shard'][0].as_py():06d}", _Out().put(keys).counts(n).bytes())
        rows = [(shards, _Out().put(_count_counts(n)).bytes())]
        # of each word: pairs it begins that occur once, twice, more often; pairs it ends; its tokens
        one_of = np.ones(len(n), dtype=np.int64)
        f, _, f1, f2, f3 = _totals(first, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
        s, _, kinds, total = _totals(second, one_of, n)
        for shard, own in _blobs(shard_of(f, shards), shards):
            rows.append((shard, b"f" * 8 + _Out().put(f[own]).counts(f1[own]).counts(f2[own]).counts(f3[own]).bytes()))
        for shard, own in _blobs(shard_of(s, shards), shards):
            rows.append((shard, b"s" * 8 + _Out().put(s[own]).counts(kinds[own]).counts(total[own]).bytes()))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _word_shards(uri: str, stats: int):  # noqa: ANN202
    """stats: the shard whose rows carry totals instead of words."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        out = np.zeros(16, dtype=np.int64)
        if shard == stats:
            for blob in group["blob"]:
                out[:4] += _In(blob.as_buffer()).take(np.int64)
        else:
            keys, values = [], []
            for blob in group["blob"]:
                raw = blob.as_py()
                read = _In(raw)
                read.at = 8
                keys.append(read.take(np.uint64))
                own = np.zeros((len(keys[-1]), 5), dtype=np.int64)
                for i in (0, 1, 2) if raw[:1] == b"f" else (3, 4):
                    own[:, i] = read.counts()
                values.append(own)
            words, _, *sums = _totals(np.concatenate(keys), *np.concatenate(values).T)
            file = _Out().put(words)
            for x in sums:
                file.counts(x)
            write_file(f"{uri}/words-{shard:06d}", file.bytes())
            out[4:8] = _count_counts(sums[3])
            out[8:12] = np.count_nonzero(sums[4]), sums[4].sum(), sums[3].sum(), np.count_nonzero(sums[3] > 2)
        return pa.table({"stat": pa.array([out.tolist()], pa.list_(pa.int64()))})

    return run


def _lookup(files: list[tuple], wanted: np.ndarray, shards: np.ndarray, columns: int) -> np.ndarray:
    """Counts (columns, wanted) from sharded sorted arrays; 0 where a key is absent. wanted and its shards, in any order."""
    out = np.zeros((columns, len(wanted)), dtype=np.int64)
    order = np.lexsort((wanted, shards))
    edges = np.searchsorted(shards[order], np.arange(len(files) + 1))
    for s in np.flatnonzero(np.diff(edges)):
        keys, packs = files[s]
        if not len(keys):
            continue
        own = order[edges[s] : edges[s + 1]]
        at = np.searchsorted(keys, wanted[own])
        at[at == len(keys)] = 0
        hit = keys[at] == wanted[own]
        own, at = own[hit], at[hit]
        for c, (small, large, values) in enumerate(packs):
            n = small[at].astype(np.int64)
            big = np.flatnonzero(n == 255)
            n[big] = values[np.searchsorted(large, at[big])]
            out[c, own] = n
    return out


class Model:
    """A model written by count(): few numbers, and the URI of its files."""

    def __init__(self, uri: str, shards: int, hot: np.ndarray, stats: np.ndarray) -> None:
        self.uri, self.shards, self.hot = uri, shards, hot
        self.pair_discounts = self._discounts(stats[:4])
        self.kind_discounts = self._discounts(stats[4:8])
        self.distinct, self.total, self.kinds = (int(x) for x in stats[8:11])
        once, twice, more = stats[4], stats[5], stats[11]
        self.spare = float(self.kind_discounts[1:] @ np.array([once, twice, more])) / max(1, self.kinds)

    @staticmethod
    def _discounts(n: np.ndarray) -> np.ndarray:
        """D for counts 0, 1, 2 and more; one half each where a count of counts needed is 0."""
        if not n.all():
            return np.array([0.0, 0.5, 0.5, 0.5])
        y = n[0] / (n[0] + 2 * n[1])
        return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01) for k in (1, 2, 3))])

    def open(self) -> None:
        """Map the files; once in a worker."""

        def read(name: str, columns: int) -> tuple:
            raw = map_file(name)
            if raw is None:
                return np.zeros(0, np.uint64), []
            at = _In(raw)
            return at.take(np.uint64), [at.packed() for _ in range(columns)]

        self.pairs = [read(f"{self.uri}/pairs-{s:06d}", 1) for s in range(self.shards)]
        self.words = [read(f"{self.uri}/words-{s:06d}", 5) for s in range(self.shards)]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of a chunk's texts."""
        second, bounds = tokens(data, offsets)
        first = histories(second, bounds)
        words, inv = np.unique(second, return_inverse=True)
        once, twice, more, kinds, n = _lookup(self.words, words, shard_of(words, self.shards), 5)
        begin = _lookup(self.words, np.array([BEGIN]), shard_of(np.array([BEGIN]), self.shards), 5)
        # what holds of a token as history: the token before, or BEGIN, which is followed as often as END occurs
        at = np.concatenate([[0], inv[:-1]])
        is_first = np.zeros(len(second), dtype=bool)
        is_first[bounds[:-1]] = True
        ends = _lookup(self.words, np.array([END]), shard_of(np.array([END]), self.shards), 5)[4, 0]
        own = self.pair_discounts[1:] @ np.stack([once, twice, more])
        held = np.where(is_first, self.pair_discounts[1:] @ begin[:3, 0], own[at])
        seen = np.where(is_first, ends, n[at])
        lower = (kinds - self.kind_discounts[np.minimum(kinds, 3)]) / max(1, self.kinds) + self.spare / (self.distinct + 1)
        if not self.kinds:
            lower = np.ones(len(words))
        keys, one, back = np.unique(pair_key(first, second), return_index=True, return_inverse=True)
        c = _lookup(self.pairs, keys, pair_shard(first[one], second[one], self.hot, self.shards), 1)[0][back]
        p = lower[inv]
        p = np.where(seen > 0, (c - self.pair_discounts[np.minimum(c, 3)] + held * p) / np.maximum(seen, 1), p)
        base = np.log10((n + 1) / (self.total + self.distinct + 1))[inv]

        def add(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, bounds[:-1])

        return np.diff(bounds), add((n > 0).astype(np.int64)[inv]), add(base), add(np.log10(p))


_open: dict[str, Model] = {}


#: Tokens of a shard, on the average: tens of MB of pairs at most, at any size of the corpus.
SHARD_TOKENS = 1 << 22


def count(train: DataFrame) -> Model:
    """Count the texts of train and write the model to the shared folder."""
    spark, texts = train.sparkSession, train.select("text")
    buckets = texts.mapInArrow(K.tidy(_bucket_counts), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, dtype=np.int64)
    for r in buckets.toArrow().to_pylist():  # as many rows as buckets at most
        total[r["bucket"]] = r["n"]
    hot = total * HOT_SHARE > total.sum()
    shards = 1 << max(4, int(total.sum() // SHARD_TOKENS).bit_length())
    uri = new_folder(spark, "kneser-ney")
    sent = texts.mapInArrow(K.tidy(_pairs(hot, shards)), "shard int, blob binary")
    words = sharded(sent, "shard", shards).groupBy("shard").applyInArrow(_pair_shards(uri, shards), "shard int, blob binary")
    stats = sharded(words, "shard", shards + 1).groupBy("shard").applyInArrow(_word_shards(uri, shards), "stat array<long>").toArrow()["stat"]  # a row for each shard
    return Model(uri, shards, hot, np.array(stats.to_pylist(), dtype=np.int64).reshape(-1, 16).sum(axis=0))


def score(model: Model, docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, and n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.types import StructType

    new = StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.uri not in _open:
            _open.clear()
            model.open()
            _open[model.uri] = model
        own = _open[model.uri]
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text"), 2 * K.CHUNK_BYTES):
                n, known, base, full = own.score(data, offsets)
                cols = [pa.array(n), pa.array(known), pa.array(np.full(b - a, own.total)), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in keep], *cols], [*keep, *new.names])

    return docs.select(*keep, "text").mapInArrow(K.tidy(run), StructType([*docs.select(*keep).schema.fields, *new.fields]))


def perplexity(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The model learns from the documents whose crc32 of doc_id modulo 7 isn't 2; a null doc_id counts as an empty text there. Null
    and empty texts are one end token. Very long texts are counted and scored whole. Repeated rows count and are scored each. Without training rows every token is
    unseen: its base probability is 1 and its score 0. No rows give no rows; other columns are left out.
    """
    held_out = crc(F.col("doc_id")) % 7 == 2
    model = count(docs.where(~held_out))
    out = score(model, docs.select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity(table(spark, sf_dir, "documents"))
