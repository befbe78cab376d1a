"""Product codes against plain Lloyd rounds in Python integers; circulant signatures against their definition, near-duplicates against all pairs."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from meshql.llm import elkan, jaccard, minhash

from .test_text_ops import components_by_hand

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    m = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * m : (p + 1) * m] for r in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * m : (p + 1) * m], c, strict=True)), j) for j, c in enumerate(books[p]))

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                held[p][nearest(p, v)[1]].append(v[p * m : (p + 1) * m])
        books = [[[sum(x) // len(held[p][j]) for x in zip(*held[p][j], strict=True)] if j in held[p] else c for j, c in enumerate(books[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found, by_label = [], defaultdict(int)
    for i, v, label in kept:
        best = [nearest(p, v) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        found.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in found), key=str)


def codes(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in elkan.product_codes(df, **options).collect()), key=str)


def vectors(n, seed, dims=16, coarse=False):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dims))
    out = []
    for i in range(n):
        x = centres[r.integers(20)] + 0.3 * r.normal(size=dims)
        out.append((i * 3, [float(a) for a in (np.round(x * 2) / 4096 if coarse else x).astype(np.float32)], int(r.integers(4)) if i % 7 else None))
    return out


@pytest.mark.parametrize("coarse", [False, True])  # coarse: a few small integers a component, so that most distances tie
def test_codes_equal_plain_rounds(spark, coarse):
    rows = vectors(300, 1 + coarse, coarse=coarse)
    assert codes(spark, rows) == codes_by_hand(rows)


def test_codes_of_odd_rows(spark):
    rows = vectors(40, 5)
    rows += [(500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 16, 2), (503, [float("-inf")] + [0.0] * 15, 2), (504, [], 1), (505, [0.5, -0.25, 0.125], None)]
    rows += [rows[3], rows[3], (None, [0.25] * 16, 3), (6, [-0.5] * 16, 3), (6, [-0.25] * 16, 3)]
    found = codes(spark, rows)
    assert found == codes_by_hand(rows) and len(found) == 47
    few = vectors(5, 6, dims=11)
    assert codes(spark, few) == codes_by_hand(few)
    assert codes(spark, []) == [] and codes(spark, [(1, None, 1)]) == []
    large = elkan.product_codes(spark.createDataFrame([(i, [3e38 * (-1) ** i] * 8, 1, "x", 1) for i in range(3)], SCHEMA)).collect()
    assert {r["error"] for r in large} == {0} and len(large) == 3


def test_codes_with_labels_joined(spark, monkeypatch):
    monkeypatch.setattr(elkan, "BROADCAST_LABELS", 0)
    rows = vectors(100, 8)
    assert codes(spark, rows) == codes_by_hand(rows)


def test_bounds_hold_and_spare_distances():
    """Every kept bound is on its side of the exact distance in every round, entries are the nearest with ties to the lower index, and most distances aren't taken."""
    r = np.random.default_rng(3)
    centres = r.integers(-3000, 3000, (16, 2, 8))
    x = centres[r.integers(16, size=2000)] + r.integers(-300, 300, (2000, 2, 8))
    books = x[:16].transpose(1, 0, 2).copy()
    bounds, moved, taken = elkan.Bounds.none(2000, 2, 16), np.zeros((2, 16)), []
    for _ in range(6):
        bounds = elkan.Bounds.read(bounds.blobs(), 2, 16)
        taken.append(elkan.assign(x, books, moved, bounds)[1])
        true = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        assert (bounds.own == true.argmin(axis=2)).all()
        assert (elkan.wide(bounds.low) <= np.sqrt(true)).all()
        assert (elkan.wide(bounds.high) >= np.sqrt(np.take_along_axis(true, bounds.own[:, :, None].astype(int), axis=2)[:, :, 0])).all()
        total = elkan.sums(x, bounds.own, 16)
        fresh = np.where(total[:, :, :1] > 0, total[:, :, 1:] // np.maximum(1, total[:, :, :1]), books)
        moved, books = np.sqrt(((fresh - books) ** 2).sum(axis=2)), fresh
    assert taken[0] <= 2000 * 2 * 16 and max(taken[2:]) < 2000 * 2 * 16 // 4


def test_halves_of_floats_bound():
    x = np.concatenate([np.zeros(1), 10 ** np.random.default_rng(1).uniform(-3, 9, 5000), np.arange(1, 600.0) ** 2])
    low, high = elkan.wide(elkan.down(x)), elkan.wide(elkan.up(x))
    assert (low <= x).all() and (high >= x).all() and (high[1:] <= 1.02 * x[1:]).all() and (low >= 0.98 * x).all()


def test_permutations_and_shifts():
    places = minhash.scatter((np.arange(1 << minhash.PLACES, dtype=np.uint64)) << np.uint64(64 - minhash.PLACES))
    assert len(np.unique(places)) == 1 << minhash.PLACES and places.max() == (1 << minhash.PLACES) - 1
    order = minhash.ranks(30)
    size = 1 << minhash.PLACES
    assert len(np.unique(order[:size])) == size and (order[size:] == order[:30]).all()
    r = np.random.default_rng(2)
    count = [0, 3, 1, 70_000, 0, 500]  # one set goes over several steps
    keys = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in count]
    rows = np.repeat(np.arange(6), [len(k) for k in keys])
    got = minhash.signatures(rows, np.concatenate(keys), 6, 30)
    for i, own in enumerate(keys):
        at = minhash.scatter(own)
        want = [order[(at + k) % size].min() if len(own) else 2**32 - 1 for k in range(30)]
        assert got[i].tolist() == want


def test_equal_coordinates_estimate_jaccard():
    r = np.random.default_rng(7)
    for share in (0.3, 0.6, 0.9):
        both = r.integers(0, 2**64, int(1000 * share), dtype=np.uint64)
        rest = r.integers(0, 2**64, 1000 - len(both), dtype=np.uint64)
        a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
        found = minhash.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, 600)
        assert abs((found[0] == found[1]).mean() - share) < 0.08


def near_texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(800)]
    texts = []
    while len(texts) < n:
        if texts and r.random() < 0.7:
            own = (r.choice(texts) or "").split(" ")
            for _ in range(r.randint(0, max(1, len(own) // 60))):
                own[r.randrange(len(own))] = r.choice(words)
        else:
            own = r.choices(words, k=r.randint(1, 300))
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("part", [2048, 1])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(minhash, "PART", part)
    texts = near_texts(150, part)
    rows = [(i * 2, t) for i, t in enumerate(texts)] + [(1, None), (3, ""), (5, " \t\n"), (7, texts[0].upper()), (9, "one two"), (11, "ONE  two")]
    df = spark.createDataFrame([(i, t, i, "x", 0) for i, t in rows], "doc_id long, text string, n long, fp string, c int").repartition(3)
    found = minhash.near_duplicates(df).collect()
    want = components_by_hand(rows, percent=85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and len(found) == len(rows)
    assert 20 < sum(r["kept"] for r in found) < 120


def test_near_duplicates_of_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (2, text), (None, text), (None, "alone here"), (8, None)]
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == sorted([(4, 26, 2, False), (4, 26, 2, False), (2, 26, 2, True), (None, 26, 2, False), (None, 1, None, True), (8, 0, 8, True)], key=str)


def test_lists_with_one_component_are_dropped(spark):
    mixed = spark.createDataFrame([(0, 7, 1, 5), (0, 7, 2, 5), (0, 8, 3, 5), (0, 8, 4, 6)], "shard int, token long, fp long, comp long")
    hubs = spark.createDataFrame([(7, 1, 5), (8, 3, 5)], "token long, hub long, hub_n long")
    led = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "fp long, lead long")
    left = minhash.open_lists(mixed, hubs, led, 4).collect()
    assert {(r["token"], r["fp"]) for r in left} == {(8, 3), (8, 4)}


def test_sketches_rule_out_near_texts_that_are_not_linked():
    r, keys = np.random.default_rng(3), np.sort(np.random.default_rng(4).integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    n, size = 60, 100
    common = r.choice(4000, 82, replace=False)  # two sets share 82 of 100, 0.69 of their union
    others = np.setdiff1d(np.arange(4000), common)
    own = [np.sort(np.concatenate([common, others[r.choice(len(others), size - 82, replace=False)]])) for _ in range(n)]
    own[1] = np.sort(np.concatenate([own[0][own[0] != common[0]], others[:1]]))  # linked with the first, unless it has others[0] already
    rows, at = np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate(own)
    bits = jaccard.sketches(rows, keys[at], n)
    words = np.ascontiguousarray(bits).view(np.uint64)
    i, j = np.triu_indices(n, 1)
    sizes = np.array([len(x) for x in own])
    both = np.array([len(np.intersect1d(own[a], own[b])) for a, b in zip(i, j, strict=True)])
    assert (jaccard.most_overlap(words[i], words[j], sizes[i], sizes[j]) >= both).all()
    entries = {"shard": [0] * n, "token": [7] * n, "fp": list(range(n)), "comp": list(range(n)), "block": [0] * n, "n": sizes.tolist(), "place": [0] * n, "hub_n": [size] * n, "both": [None] * n, "bits": [None] * n}
    drawn = {k: [None] * n for k in entries} | {"shard": [0] * n, "fp": list(range(n)), "bits": [x.tobytes() for x in bits]}
    kinds = {k: pa.int64() for k in entries} | {"both": pa.float64(), "bits": pa.binary()}
    table = pa.table({k: pa.array(entries[k] + drawn[k], kinds[k]) for k in entries})
    found = jaccard._rest(85)(table)
    pairs = {tuple(x) for x in np.frombuffer(b"".join(found["pairs"].to_pylist()), dtype=np.int64).reshape(-1, 2).tolist()}
    linked = {(int(a), int(b)) for a, b, o in zip(i, j, both, strict=True) if 100 * o >= 85 * (sizes[a] + sizes[b] - o)}
    assert linked == {(0, 1)} <= pairs and len(pairs) < 20
    plain = jaccard._rest(85)(table.filter(table["bits"].is_null()).drop_columns("bits"))
    assert len(np.frombuffer(plain["pairs"][0].as_py(), dtype=np.int64)) == n * (n - 1)


def test_links_share_a_band_but_for_one_in_a_million():
    assert (1 - (minhash.PERCENT / 100) ** minhash.ROWS) ** minhash.BANDS < 1e-6
    assert jaccard.WORDS == minhash.WORDS == 5
