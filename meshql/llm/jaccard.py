"""Exact n-gram Jaccard self-join with set-relation skipping, giving the components of linked documents.

Each document is the set of its word n-grams. Sets meet in index lists of their rarest n-grams (prefix filter). Two relations between sets save work:
inside a list, entries of one size and position form blocks that are skipped together when no pair of them can share enough;
and answers are reused: those of a list's hub, to which its other entries are compared first, bound those of the entries that it is
similar to, so that most pairs of a group are settled by what is known of both against the hub, or by being connected already; of what
is left, a set's answers are derived from a highly similar set's by the n-grams in which the two differ.

Lists never leave the task that holds their n-gram's shard as pairs: what has to be compared travels as packed arrays
by pairs of blocks of similar sets. Equal sets are one entry throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .kneser_ney import _blobs, _In, _Out, _totals
from .shared import cut, new_folder, sharded, table

WORDS, PERCENT = 5, 80
#: Buckets of the table of n-gram counts that orders n-grams from rare to frequent: 1 MB for any input. It bears on speed, not on results.
SKETCH_BITS, SLICES = 20, 64
#: Entries of a map task's index before it is sent, and sets in a block.
FLUSH, BLOCK = 2_000_000, 512
#: Up to so many ids are sent to the workers to fetch texts; with more, the texts are joined.
BROADCAST_IDS = 2_000_000
#: Entries of a shard of index lists, on the average: tens of MB at any size of the corpus.
SHARD_ENTRIES = 1 << 20
#: Ends of edges in a partition of components.
NODES = 100_000
#: Bits of a set's sketch; for sets of many more n-grams it rules out less.
SKETCH = 2048
#: Pairs whose sketches are compared at once: some tens of MB.
SKETCHED = 1 << 15
U64 = np.uint64


def sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of a chunk's texts, ordered by both."""
    low = K.LOWER[data]
    starts, ends, bounds = K.word_spans(low, offsets)
    rows, keys = K.shingles(K.span_hashes(low, starts, ends), bounds, words)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    return rows[new], keys[new]


def prints(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and fingerprints of n sets. Equal sets have equal fingerprints; others differ but for one in 2**64 pairs."""
    size = np.bincount(rows, minlength=n)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(K.mix(keys ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
    ends = np.cumsum(size)
    return size, K.mix(total[ends] - total[ends - size] + size.astype(U64))


def sketches(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """(n, SKETCH / 8) bytes: of each of n sets a bit for each bucket that one of its n-grams is in."""
    at = np.unique(rows * SKETCH + (keys >> U64(64 - (SKETCH.bit_length() - 1))).astype(np.int64))
    return np.bincount(at >> 3, 1 << (at & 7), n * SKETCH // 8).astype(np.uint8).reshape(n, SKETCH // 8)


def most_overlap(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of sets by their sketches as 64-bit words: the bits that both have, and what may hide in bits that several n-grams of a set share."""
    hidden = np.minimum(size_a - np.bitwise_count(a).sum(axis=1, dtype=np.int64), size_b - np.bitwise_count(b).sum(axis=1, dtype=np.int64))
    return np.bitwise_count(a & b).sum(axis=1, dtype=np.int64) + hidden


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection with 100 * intersection >= percent * union, for sets of sizes a and b."""
    return -(-(a + b) * percent // (100 + percent))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SIGNED = "doc long, n long, fp long, shard int, blob binary"


def _signatures(words: int):  # noqa: ANN202
    """A row with size and fingerprint for each text, and at a task's end rows with its counts of n-grams by bucket, packed by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                rows, keys = sets(data, offsets, words)
                size, fp = prints(rows, keys, b - a)
                total += np.bincount((keys >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, b - a), pa.array(size), _longs(fp), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], SIGNED_NAMES)
        parts = total.reshape(SLICES, -1)
        held = np.flatnonzero(parts.any(axis=1))
        none = pa.nulls(len(held), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(held.astype(np.int32)), pa.array([_Out().counts(parts[s]).bytes() for s in held], pa.binary())], SIGNED_NAMES)

    return run


SIGNED_NAMES = [x.split()[0] for x in SIGNED.split(", ")]


def _sum_slices(group: pa.Table) -> pa.Table:
    total = sum(_In(b.as_buffer()).counts() for b in group["blob"])
    code = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
    return pa.table({"shard": group["shard"].slice(0, 1).combine_chunks(), "blob": pa.array([code.tobytes()], pa.binary())})


def frequency_codes(signed: DataFrame) -> np.ndarray:
    """For each bucket of n-grams a code that grows with their count over all texts, from the rows of counts among `signed`."""
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.uint8)
    parts = signed.where("shard is not null").select("shard", "blob").groupBy("shard").applyInArrow(_sum_slices, "shard int, blob binary")
    for s, blob in parts.collect():  # 64 rows of 16 kB
        out[s] = np.frombuffer(blob, dtype=np.uint8)
    return out.ravel()


def _index(words: int, percent: int, codes, shards: int):  # noqa: ANN001, ANN202
    """Prefix entries (n-gram, set, size, position) of a task's texts, packed by shard of the n-gram."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, fp, size, place = (np.concatenate(x) for x in zip(*held, strict=True))
        _, one, *_ = _totals(K.mix(key + fp * U64(3)))  # equal sets of a task go once
        key, fp, size, place = key[one], fp[one], size[one], place[one]
        rows = [(s, _Out().put(key[own]).put(fp[own]).put(size[own].astype(np.uint32)).put(place[own].astype(np.uint32)).bytes()) for s, own in _blobs((key >> U64(64 - (shards.bit_length() - 1))).astype(np.int64), shards)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, n = codes.value, [], 0
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                rows, keys = sets(data, offsets, words)
                size, fp = prints(rows, keys, b - a)
                rank = code[(keys >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((keys, rank, rows))
                keys, rows = keys[order], rows[order]
                place = np.arange(len(rows)) - (np.cumsum(size) - size)[rows]
                prefix = size - (-(-size * percent // 100)) + 1
                take = np.flatnonzero(place < prefix[rows])
                rows = rows[take]
                held.append((keys[take], fp[rows], size[rows], place[take]))
                n += len(take)
                if n >= FLUSH:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _fits(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be linked if this n-gram, at these positions, is the first that they share."""
    rest = np.minimum(n1 - p1, n2 - p2)
    return rest >= least_overlap(n1, n2, percent)


def _lists(percent: int):  # noqa: ANN202
    """The index lists of a shard that hold two sets or more. hub: the list's set that all others are compared with first."""

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for blob in group["blob"]:
            read = _In(blob.as_buffer())
            parts.append((read.take(U64), read.take(U64), read.take(np.uint32), read.take(np.uint32)))
        key, fp, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((K.mix(fp), key))
        key, fp, size, place = key[order], fp[order], size[order].astype(np.int64), place[order].astype(np.int64)
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp, size, place = key[new], fp[new], size[new], place[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        live = np.repeat(count > 1, count)
        hub = np.repeat(first, count)
        pair = (np.arange(len(key)) != hub) & _fits(size, place, size[hub], place[hub], percent)
        cols = {"shard": pa.array(np.full(int(live.sum()), group["shard"][0].as_py(), dtype=np.int32)), "token": _longs(key[live]), "fp": _longs(fp[live]), "n": pa.array(size[live]), "place": pa.array(place[live]), "hub": _longs(fp[hub][live]), "hub_n": pa.array(size[hub][live]), "pair": pa.array(pair[live])}
        return pa.table(cols)

    return run


LISTS = "shard int, token long, fp long, n long, place long, hub long, hub_n long, pair boolean"


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def _unpack(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(x for x in column.to_pylist() if x)
    return np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)


#: Sets of fewer n-grams are compared anew; for larger ones answers are derived if so much of a set, in hundredths, is the other's too.
DERIVE_SIZE, DERIVE_SHARE = 128, 60


def _common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Mask of those of p that q has; both sorted."""
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    return q[at] == p


class _Answers:
    """Overlaps of a run of sets with others. Where a set is highly similar to one whose overlaps are known, its own are derived from those.

    With base B and set X, X's overlap with Y is B's, plus what Y has of X without B, less what Y has of B without X. Both differences are taken once.
    """

    def __init__(self, found: dict[int, np.ndarray]) -> None:
        self.found = found
        self.base, self.known = None, {}
        self.of, self.plus, self.minus = None, None, None
        self.derived = 0

    def overlap(self, x: int, y: int) -> int:
        p, q = self.found[x], self.found[y]
        if len(p) < DERIVE_SIZE:
            return int(np.count_nonzero(_common(p, q)))
        if x != self.base and x != self.of:
            self._begin(x, p)
        if x == self.base:
            both = self.known[y] = int(np.count_nonzero(_common(p, q)))
            return both
        if y not in self.known:
            return int(np.count_nonzero(_common(p, q)))
        self.derived += 1
        return self.known[y] + int(np.count_nonzero(_common(self.plus, q))) - int(np.count_nonzero(_common(self.minus, q)))

    def _begin(self, x: int, p: np.ndarray) -> None:
        if self.base is not None:
            b = self.found[self.base]
            own = _common(p, b)
            if 100 * np.count_nonzero(own) >= DERIVE_SHARE * max(len(p), len(b)):
                self.of, self.plus, self.minus = x, p[~own], b[~_common(b, p)]
                return
        self.base, self.known, self.of = x, {}, None


def _compare(words: int, percent: int, all_answers: bool):  # noqa: ANN202
    """Compare the pairs of a group whose sets' texts are in the same group.

    all_answers: give every pair's overlap. Otherwise give links alone, and leave out pairs that are connected already.
    """

    def run(group: pa.Table) -> pa.Table:
        is_set = group["pairs"].is_null()
        members, pairs = group.filter(is_set), np.unique(_unpack(group["pairs"]), axis=0)
        order = np.unique(members["fp"].to_numpy(), return_index=True)[1]
        members = members.take(pa.array(order))
        found: dict[int, np.ndarray] = {}
        own, comp = members["fp"].to_pylist(), dict(zip(members["fp"].to_pylist(), members["comp"].to_pylist(), strict=True))
        for a, b, data, offsets in K.chunks(members["text"]):
            rows, keys = sets(data, offsets, words)
            edges = np.searchsorted(rows, np.arange(b - a + 1))
            for i in range(b - a):
                found[own[a + i]] = keys[edges[i] : edges[i + 1]]
        union, out, answers = _Union(), [], _Answers(found)
        for x, y in pairs.tolist():
            cx, cy = comp[x], comp[y]
            if not all_answers and union.find(cx) == union.find(cy):
                continue
            both = answers.overlap(x, y)
            linked = 100 * both >= percent * (len(found[x]) + len(found[y]) - both)
            if linked:
                union.join(cx, cy)
            if linked or all_answers:
                out.append((x, y, both, linked))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64()), "both": pa.array(cols[2], pa.int64()), "linked": pa.array(cols[3], pa.bool_())})

    return run


def _rest(percent: int):  # noqa: ANN202
    """Pairs of a shard's lists that are still open, packed by their blocks.

    Entries of one size and position are a block of the list; pairs of blocks are skipped by the size and position filter at once. Of the others go
    pairs of different components that what is known of both sets against the list's hub doesn't rule out, nor their sketches, where the shard has rows of them
    (fp, bits): texts travel for the pairs left alone.
    """

    def run(group: pa.Table) -> pa.Table:
        drawn = None
        if "bits" in group.column_names:
            has = group["bits"].is_valid()
            held, group = group.filter(has), group.filter(pc.invert(has))
            drawn_fp = held["fp"].to_numpy()
            by_fp = np.argsort(drawn_fp)
            drawn_fp, drawn = drawn_fp[by_fp], np.frombuffer(b"".join(held["bits"].to_pylist()), dtype=U64).reshape(-1, SKETCH // 64)[by_fp]
        token, fp, comp, block = (group[c].to_numpy() for c in ("token", "fp", "comp", "block"))
        size, place, hub_n = (group[c].to_numpy() for c in ("n", "place", "hub_n"))
        known = group["both"].to_numpy(zero_copy_only=False).astype(float)  # overlap with the hub, or NaN
        order = np.lexsort((place, size, token))
        token, fp, comp, block, size, place, known = (x[order] for x in (token, fp, comp, block, size, place, known))
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        taken: list[np.ndarray] = []
        place_of = None if drawn is None else np.searchsorted(drawn_fp, fp)

        def possible(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether the sketches of entries i and j allow a link."""
            ok = np.ones(len(i), dtype=bool)
            for at in range(0, len(i) if drawn is not None else 0, SKETCHED):
                x, y = i[at : at + SKETCHED], j[at : at + SKETCHED]
                ok[at : at + SKETCHED] = most_overlap(drawn[place_of[x]], drawn[place_of[y]], size[x], size[y]) >= least_overlap(size[x], size[y], percent)
            return ok

        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (comp[a:b] == comp[a]).all():
                continue
            n, p = size[a:b], place[a:b]
            cuts = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (p[1:] != p[:-1]), [True]]))
            bn, bp = n[cuts[:-1]], p[cuts[:-1]]
            for k in range(len(bn)):
                near = np.flatnonzero(_fits(bn[k], bp[k], bn[k:], bp[k:], percent)) + k
                if not len(near):
                    continue
                left = np.arange(a + cuts[k], a + cuts[k + 1])
                right = np.concatenate([np.arange(a + cuts[m], a + cuts[m + 1]) for m in near])
                for at in range(0, len(left), max(1, 1_000_000 // len(right))):
                    i = np.repeat(left[at : at + max(1, 1_000_000 // len(right))], len(right))
                    j = np.tile(right, len(i) // len(right))
                    ok = (i < j) & (comp[i] != comp[j])
                    i, j = i[ok], j[ok]
                    most = np.minimum(known[i], known[j]) + np.minimum(size[i] - known[i], size[j] - known[j])
                    ok = ~(most < least_overlap(size[i], size[j], percent))
                    i, j = i[ok], j[ok]
                    ok = possible(i, j)
                    if ok.any():
                        taken.append(np.stack([i[ok], j[ok]], axis=1))
        if not taken:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "pairs": pa.array([], pa.binary()), "fps": pa.array([], pa.list_(pa.int64()))})
        at = np.concatenate(taken)
        swap = block[at[:, 0]] > block[at[:, 1]]
        at[swap] = at[swap][:, ::-1]
        x, y = np.minimum(fp[at[:, 0]], fp[at[:, 1]]), np.maximum(fp[at[:, 0]], fp[at[:, 1]])
        all_pairs, one = np.unique(np.stack([x, y], axis=1), axis=0, return_index=True)
        ba, bb = block[at[one, 0]], block[at[one, 1]]
        order = np.lexsort((bb, ba))
        all_pairs, ba, bb = all_pairs[order], ba[order], bb[order]
        edges = np.flatnonzero(np.concatenate([[True], (ba[1:] != ba[:-1]) | (bb[1:] != bb[:-1]), [True]]))
        runs = [all_pairs[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"a": pa.array(ba[edges[:-1]]), "b": pa.array(bb[edges[:-1]]), "pairs": pa.array([r.tobytes() for r in runs], pa.binary()), "fps": pa.array([np.unique(r) for r in runs], pa.list_(pa.int64()))})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all ends of edges (a, b): label is the smallest node reachable. Labels spread over edges and jump along labels until nothing changes.

    What is kept between rounds has a partition for each NODES ends, so that few edges don't leave a file in every partition and round.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = 1 + both.count() // NODES
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).coalesce(parts))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("_old"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        fresh = cut(moved.join(jump, F.col("label") == F.col("_n")).select("node", F.least("label", "_l").alias("label"), "_old").coalesce(parts))
        done = fresh.where(F.col("label") != F.col("_old")).isEmpty()
        labels = fresh.select("node", "label")
        if done:
            return labels


def _texts(live: DataFrame, docs: DataFrame, words: int, drawn: bool) -> DataFrame:
    """(fp, text, bits): for every set in live (fp, doc) a text that has it, kept as a table in the shared folder. bits: the set's sketch, if they are drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                rows, keys = sets(data, offsets, words)
                _, fp = prints(rows, keys, b - a)
                same = pa.array(fp.view(np.int64) == batch.column("fp").slice(a, b - a).to_numpy())
                bits = pa.array([x.tobytes() for x in sketches(rows, keys, b - a)] if drawn else [None] * (b - a), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("fp").slice(a, b - a).filter(same), batch.column("text").slice(a, b - a).filter(same), bits.filter(same)], ["fp", "text", "bits"])

    ids = live.select("doc", "fp")
    if live.count() <= BROADCAST_IDS:  # 16 bytes each
        ids = F.broadcast(ids)
    uri = new_folder(docs.sparkSession, "texts")
    docs.join(ids, "doc").select("fp", "text").mapInArrow(K.tidy(run), "fp long, text string, bits binary").write.parquet(uri)
    return docs.sparkSession.read.parquet(uri)


def _verify(pairs: DataFrame, wanted: DataFrame, texts: DataFrame, words: int, percent: int, all_answers: bool) -> DataFrame:
    """pairs: (g, pairs binary); wanted: (g, fp, comp) whose texts the group g needs."""
    none = F.lit(None)
    left = pairs.select("g", none.cast("long").alias("fp"), none.cast("long").alias("comp"), none.cast("string").alias("text"), "pairs")
    right = wanted.join(texts.select("fp", "text"), "fp").select("g", "fp", "comp", "text", none.cast("binary").alias("pairs"))
    return left.unionByName(right).groupBy("g").applyInArrow(_compare(words, percent, all_answers), "a long, b long, both long, linked boolean")


def _groups(n: int) -> int:
    """Groups of about a thousand texts."""
    return max(16, n // 1024)


def near_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of distinct n-word shingles (A-Z lower-cased, words
    parted by white space). A text with fewer words is one shingle as a whole; null, empty and blank texts have an empty set and no links.
    component_id is the smallest doc_id reachable by links. A null doc_id counts as the largest and stays null where no other is reached.
    Repeated rows link with each other. Very long texts are taken whole. No rows give no rows; other columns are left out. Sets are told apart
    by 64-bit hashes.
    """
    far = 2**63 - 1
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(far)).alias("doc"), "text")
    texts_only = base.select("text")
    signed = cut(base.mapInArrow(K.tidy(_signatures(words)), SIGNED))
    codes = docs.sparkSession.sparkContext.broadcast(frequency_codes(signed))
    signed = signed.where("shard is null").select("doc", "n", "fp")
    shards = 1 << max(5, int((signed.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100 // SHARD_ENTRIES).bit_length())
    sent = texts_only.mapInArrow(K.tidy(_index(words, percent, codes, shards)), "shard int, blob binary")
    lists = cut(sharded(sent, "shard", shards).groupBy("shard").applyInArrow(_lists(percent), LISTS))
    return linked_components(base, signed, lists, lambda mixed, *_: sharded(mixed, "shard", shards), words, percent)


def linked_components(base: DataFrame, signed: DataFrame, lists: DataFrame, dealt: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], words: int, percent: int, *, drawn: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) from the lists in which sets meet, every link confirmed on the full sets.

    base: (doc, text). signed: (doc, n, fp), a row for each of base. lists: LISTS, whatever index they come from. dealt: brings the entries of a shard together, given them, (fp, lead), the set that each set stands with, and
    with `drawn` (fp, bits), the sets' sketches, of which it adds a shard's.
    """
    far = 2**63 - 1
    least = signed.where("n > 0").groupBy("fp").agg(F.min("doc").alias("doc"))
    live = least.join(lists.select("fp").distinct(), "fp")
    texts = _texts(live, base, words, drawn)

    # every list's sets against its hub
    stars = lists.where("pair").select("hub", "fp").distinct()
    total = stars.count()
    stars = stars.withColumn("g", F.pmod(F.xxhash64("hub", F.pmod(F.xxhash64("fp"), F.lit(1 + total // 4096))), F.lit(_groups(total))))

    def packed(g: Column, a: Column, b: Column) -> DataFrame:
        return stars.select(g.alias("g"), a.alias("a"), b.alias("b")).mapInArrow(_pack, "g long, pairs binary")

    ends = stars.select("g", F.col("hub").alias("fp")).unionByName(stars.select("g", "fp")).distinct().withColumn("comp", F.col("fp"))
    answers = cut(_verify(packed(F.col("g"), F.col("hub"), F.col("fp")), ends, texts, words, percent, True))
    links = answers.where("linked").select("a", "b")
    labels = components(links)

    # blocks: sets that are similar to one hub stand together
    sizes = lists.select("fp", "n").distinct()
    near = answers.join(lists.where("pair").select(F.col("hub").alias("a"), F.col("fp").alias("b"), (F.col("n") + F.col("hub_n")).alias("sum")).distinct(), ["a", "b"])
    share = F.col("both") / (F.col("sum") - F.col("both"))
    lead = cut(near.where(share >= 0.5).groupBy(F.col("b").alias("fp")).agg(F.max_by("a", share).alias("lead")))
    for _ in range(2):
        lead = lead.join(lead.select(F.col("fp").alias("_f"), F.col("lead").alias("_l")), F.col("lead") == F.col("_f"), "left").select("fp", F.coalesce("_l", "lead").alias("lead"))
    led = cut(sizes.join(lead, "fp", "left").select("fp", F.coalesce("lead", "fp").alias("lead")))
    counted = led.groupBy("lead").agg(F.count("*").alias("c"))
    sets_of = (
        led.join(counted, "lead").join(labels, F.col("fp") == F.col("node"), "left")
        .select("fp", F.coalesce("label", "fp").alias("comp"), F.xxhash64("lead", F.pmod(F.xxhash64("fp"), F.ceil(F.col("c") / BLOCK))).alias("block"))
    )
    sets_of = cut(sets_of)
    entries = lists.join(sets_of, "fp").join(answers.select(F.col("a").alias("hub"), F.col("b").alias("fp"), "both"), ["hub", "fp"], "left")
    mixed = entries.select("shard", "token", "fp", "comp", "block", "n", "place", "hub_n", F.when(F.col("fp") == F.col("hub"), F.col("n")).otherwise(F.col("both")).cast("double").alias("both"))
    rest = cut(dealt(mixed, led, texts.select("fp", "bits")).groupBy("shard").applyInArrow(_rest(percent), "a long, b long, pairs binary, fps array<long>"))
    groups = _groups(rest.select(F.coalesce(F.sum(F.size("fps")), F.lit(0))).first()[0])
    rest = rest.withColumn("g", F.pmod(F.xxhash64("a", "b"), F.lit(groups)))
    needed = rest.select("g", F.explode("fps").alias("fp")).distinct().join(sets_of.select("fp", "comp"), "fp")
    more = _verify(rest.select("g", "pairs"), needed, texts, words, percent, False).where("linked").select("a", "b")
    labels = components(links.unionByName(more))

    member = least.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("label", "fp").alias("label"))
    first = member.groupBy("label").agg(F.min("doc").alias("first"))
    class_of = member.join(first, "label").select("fp", "first")
    own = signed.withColumn("fp", F.when(F.col("n") > 0, F.col("fp")).otherwise(F.xxhash64("doc", F.lit("empty"))))
    out = own.join(class_of, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc"))
    return out.select(F.nullif("doc", F.lit(far)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(component, F.lit(far)).alias("component_id"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        g, a, b = (batch.column(c).to_numpy() for c in ("g", "a", "b"))
        order = np.argsort(g, kind="stable")
        g, both = g[order], np.stack([a, b], axis=1)[order]
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(g[edges[:-1]]), pa.array([both[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["g", "pairs"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)
), r(x, y) AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, min(r.y)), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""
