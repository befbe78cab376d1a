"""Operators on documents against brute force, and their defined results for odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshql.llm import bpe, hilbert, jaccard, kneser_ney, line_dedup, repetition
from meshql.llm import textkit as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n", "a", "b b", "Über ÀÉ é", "x\x0by\x0cz\r\nq", "one two three four", "é" * 30, "tail \n", "\n\n"]
SCHEMA = "doc_id long, text string, extra int, n_lines string, _doc int, hilbert string, score string"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def with_odd_columns(spark, texts):
    return frame(spark, [(i, t, 1, "x", 2, "y", "z") for i, t in enumerate(texts)], SCHEMA)


def random_texts(n, seed, words=60, vocabulary=300):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(vocabulary)]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = re.findall(r"\S+|\n", r.choice(out) or "")
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = r.choices(vocab, k=r.randint(0, words))
            for _ in range(r.randint(0, 3)):
                w.insert(r.randint(0, len(w)), "\n")
        out.append(" ".join(w))
    return out


# --- kernels ---------------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    texts = [*ODD, *random_texts(50, 1)]
    seen = {}
    for a, b, data, offsets in K.chunks(pa.array(texts), 100):
        starts, ends, bounds = K.word_spans(data, offsets)
        hashes = K.span_hashes(data, starts, ends)
        for i in range(a, b):
            own = [data[s:e].tobytes() for s, e in zip(starts[bounds[i - a] : bounds[i - a + 1]], ends[bounds[i - a] : bounds[i - a + 1]], strict=True)]
            assert own == (texts[i] or "").encode().split()
            for w, h in zip(own, hashes[bounds[i - a] :], strict=False):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_ngrams_stay_in_rows():
    words = np.arange(10, dtype=np.uint64)
    keys, at = K.ngram_hashes(words, np.array([0, 2, 2, 3, 10]), 3)
    assert at.tolist() == [3, 4, 5, 6, 7] and len(set(keys.tolist())) == 5


# --- line dedup --------------------------------------------------------------------------------------------------------------


def dedup_by_hand(rows, min_chars=20, min_docs=3):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line).strip(" \t\n\x0b\x0c\r")

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == (-(2**63) if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    hot, other = "This is a LINE that many documents hold", "another line of more than twenty letters é"
    rows = [(i, f"own {i}\n {hot}\t\nmiddle\n{hot.lower()}\r\nlast") for i in range(6)] + [(7, other), (8, other + "\n"), (9, f"{other}\n{hot}"), (9, f"{other}\n{hot}"), (9, hot + " differs"), (None, hot), (None, None), (10, "short\nshort"), (11, ""), (12, "short")]
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == dedup_by_hand(rows)


def test_line_dedup_keeps_other_columns(spark):
    out = line_dedup.dedup_lines(with_odd_columns(spark, ODD))
    assert {c: out.first()[c] for c in ("extra", "_doc", "hilbert")} == {"extra": 1, "_doc": 2, "hilbert": "y"}
    assert sorted(r["text"] for r in out.collect()) == sorted(t or "" for t in ODD)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_long_text(spark):
    line = "a line that is held by three documents"
    rows = [(i, "\n".join([line, *[f"row {j} of document {i} which is long" for j in range(20_000)]])) for i in range(3)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [got[i]["n_dropped"] for i in range(3)] == [1, 1, 0] and all(got[i]["n_lines"] == 20_001 for i in range(3))


# --- Jaccard -------------------------------------------------------------------------------------------------------------------


def components_by_hand(rows, words=5, percent=80):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = defaultdict(lambda: 2**63)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], 2**63 - 1 if i is None else i)
    return sorted(((i, len(sets[k]), i if not sets[k] else None if least[find(k)] == 2**63 - 1 else least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    texts = [*random_texts(250, seed, words=40), *ODD, *ODD]
    base = random_texts(1, 9, words=120, vocabulary=5000)[0] or "a b c d e f"
    r = random.Random(seed)
    for _ in range(80):  # near copies around the threshold
        w = base.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"new{r.random()}"
        texts.append(" ".join(w))
    texts += [base.upper()] * 40
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)] + [(None, base), (None, "no other text is like this one at all"), (3, texts[3])]
    got = jaccard.near_components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == components_by_hand(rows)


def test_jaccard_without_broadcast_and_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", -1)
    rows = list(enumerate(random_texts(60, 4, words=30)))
    got = jaccard.near_components(with_odd_columns(spark, [t for _, t in rows])).collect()
    assert sorted(map(tuple, got), key=str) == components_by_hand(rows)
    assert jaccard.near_components(frame(spark, [])).count() == 0


def test_blocks_are_skipped_only_if_they_cannot_link():
    for a in range(1, 40):
        for b in range(1, 40):
            least = jaccard.least_overlap(np.array(a), np.array(b), 80)
            assert all((100 * o >= 80 * (a + b - o)) == (o >= least) for o in range(min(a, b) + 1))


# --- Hilbert ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dims, bits):
    axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = hilbert.hilbert_index(axes, bits)
    assert sorted(place) == list(range(len(axes)))
    steps = np.abs(np.diff(axes[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_hilbert_shards(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 5}") for i, t in enumerate([*ODD, *random_texts(190, 3)])] + [(None, None, None, None), (5, "b b", "en", "s"), (5, "b b", "en", "s")]
    got = [r.asDict() for r in hilbert.hilbert_shards(frame(spark, rows, "doc_id long, text string, lang string, source string")).collect()]
    count = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(16))
    for s in range(16):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert all(a["hilbert"] <= b["hilbert"] for a, b in zip(ordered, ordered[1:], strict=False))
    size = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert size == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)


def test_hilbert_few_rows(spark):
    assert hilbert.hilbert_shards(frame(spark, [])).count() == 0
    got = hilbert.hilbert_shards(with_odd_columns(spark, ["a", "b"])).collect()
    assert [r["slot"] for r in got] == [0, 0] and len({r["shard"] for r in got}) == 2


# --- repetition ------------------------------------------------------------------------------------------------------------------


def repetition_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    spots = defaultdict(list)
    for i in range(len(words) - 2):
        spots[tuple(words[i : i + 3])].append(i)
    inside = {j for v in spots.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    seen, again = set(), []
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                again.append(line)
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(again), len(inside), sum(map(len, again))


def test_repetition(spark):
    texts = [*ODD, *random_texts(80, 5, vocabulary=8), "a # b\na # b\n\na # b", "ß<>|| " * 40, "A a A a A a", " ".join(f"w{i}" for i in range(60)), "x y z " * 100, ("line of it\n" * 3) + " ".join(f"w{i}" for i in range(400))]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in repetition.repetition(with_odd_columns(spark, texts)).collect()}
    for i, t in rows:
        r = got[i]
        n, chars, symbols, lines, inside, line_chars = repetition_by_hand(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["dup_line_chars"]) == (n, chars, symbols, lines, inside, line_chars), t
        assert r["base_failed"] == (n < 50 or 100 * inside > 50 * n)
        words = WORD.findall(t or "")
        for k in repetition.NGRAM_LIMITS:
            first, late = set(), set()
            for j in range(len(words) - k + 1):
                g = tuple(words[j : j + k])
                late |= set(range(j, j + k)) if g in first else set()
                first.add(g)
            assert r[f"dup_chars_{k}"] == sum(len(words[j]) for j in late)
    assert got[len(texts) - 3]["kept"] and not got[len(texts) - 2]["kept"] and got[len(texts) - 1]["kept"]
    assert repetition.repetition(frame(spark, [])).count() == 0


# --- BPE -----------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(library):
    own, r = bpe.tokenizer(bpe.vocabulary()), random.Random(2)
    strings = [s.replace("</w>", "") for s in own.vocab]
    texts = [t for t in ODD if t is not None]
    texts += ["it's WE'RE İstanbul ΣΑΣ Σ ǅ 12 345 <|endoftext|>a<|startoftext|> b", "漢字 🎉🎉 don't é ﬁ ​ \x1c \x85", "'s 't 're''ve", "<|endoftext|", "a" * 3000]
    texts += ["".join(r.choices(strings, k=r.randint(1, 6))) for _ in range(3000)] + ["".join(r.choices("abcdehilnorst", k=r.randint(1, 30))) for _ in range(3000)] + ["ab" * k for k in range(40)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == own.digest(t)[2] == library.decode(ids, skip_special_tokens=False)


def test_suffix_automaton_gives_all_matches():
    r = random.Random(5)
    for _ in range(60):
        strings = ["".join(r.choices("abc", k=r.randint(0, 40))) for _ in range(r.randint(1, 6))] + ["aaaaaaaa", "abababab"]
        tokens = {t: i for i, t in enumerate({"".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(40)})}
        trie: dict = {}
        for t, i in tokens.items():
            node = trie
            for letter in t:
                node = node.setdefault(letter, {})
            node[bpe.TOKEN] = (len(t), i)
        automaton = bpe.SuffixAutomaton(strings)
        automaton.place(trie)
        assert len(automaton.link) <= 2 * sum(map(len, strings)) + 1
        for string, states in zip(strings, automaton.prefixes, strict=True):
            for end, state in enumerate(states):
                assert sorted(automaton.ending[state]) == sorted((len(t), i) for t, i in tokens.items() if string[:end].endswith(t))


def test_bpe_windows_of_long_words(library, monkeypatch):
    own, r = bpe.WordBpe(bpe.vocabulary()), random.Random(6)
    strings = [s.replace("</w>", "") for s in own.vocab if s.replace("</w>", "").isalpha() and s.isascii()]
    monkeypatch.setattr(bpe, "CHUNK_LETTERS", 50)
    for text in ["a" * 49, "a" * 50, "a" * 51, "ab" * 500, *("".join(r.choices(strings, k=k)) for k in range(1, 120)), " ".join("".join(r.choices(strings, k=5)) for _ in range(300))]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_table(spark, library):
    texts = [*ODD, *random_texts(30, 8)]
    out = bpe.bpe(with_odd_columns(spark, texts), with_ids=True)
    assert out.columns[:7] == SCHEMA.replace(" ", ",").split(",")[::3] or "extra" in out.columns
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe(frame(spark, [])).count() == 0


# --- Kneser-Ney ----------------------------------------------------------------------------------------------------------------------


def scores_by_hand(rows):
    import math

    def tokens(t):
        return [w.lower() for w in (t or "").encode().split()] + [None]

    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    n = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([0, *t[:-1]], t, strict=True))
    total, kinds = sum(n.values()), Counter(w for _, w in pairs)

    def discounts(counts):
        c = Counter(counts)
        if not all(c[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 0.5, 0.5]
        y = c[1] / (c[1] + 2 * c[2])
        return [0, *(min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.01), k - 0.01) for k in (1, 2, 3))]

    d, e = discounts(pairs.values()), discounts(kinds.values())
    follow, branch = Counter(), defaultdict(lambda: [0, 0, 0, 0])
    for (h, _), c in pairs.items():
        follow[h] += c
        branch[h][min(c, 3)] += 1
    spare = sum(e[min(k, 3)] for k in kinds.values()) / max(1, len(pairs))

    def low(w):
        return (kinds[w] - e[min(kinds[w], 3)]) / max(1, len(pairs)) + spare / (len(n) + 1) if pairs else 1.0

    def p(h, w):
        c = pairs[h, w]
        return (c - d[min(c, 3)] + sum(d[i] * branch[h][i] for i in (1, 2, 3)) * low(w)) / follow[h] if follow[h] else low(w)

    if pairs:
        assert abs(sum(low(w) for w in n) + spare / (len(n) + 1) - 1) < 1e-9
        for h in list(follow)[:20]:
            assert abs(sum(p(h, w) for w in n) + p(h, b"never seen") - 1) < 1e-9
    out = []
    for i, t in rows:
        t = tokens(t)
        base = sum(math.log10((n[w] + 1) / (total + len(n) + 1)) for w in t)
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(t), sum(w in n for w in t), total, round(base, 8), round(sum(math.log10(p(h, w)) for h, w in zip([0, *t[:-1]], t, strict=True)), 8)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_share", [256, 3])
def test_kneser_ney(spark, monkeypatch, hot_share):
    monkeypatch.setattr(kneser_ney, "HOT_SHARE", hot_share)
    monkeypatch.setattr(kneser_ney, "FLUSH", 500)
    rows = [*enumerate([*ODD, *random_texts(120, 6, vocabulary=60), "the " * 400, "end", "end"]), (None, "a b"), (4, "b b"), (4, "b b")]
    got = kneser_ney.perplexity(frame(spark, rows)).collect()
    assert sorted((tuple(r)[:5] + (round(r[5], 8), round(r[6], 8)) for r in got), key=str) == scores_by_hand(rows)


def test_kneser_ney_without_training(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = kneser_ney.perplexity(frame(spark, [(i, "some words") for i in held])).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 3
    assert kneser_ney.perplexity(frame(spark, [])).count() == 0
