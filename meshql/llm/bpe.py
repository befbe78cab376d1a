"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is one token that can end its encoding. A suffix automaton is built over the words that are new to
a worker; the vocabulary, as a trie, is walked through it once and leaves each token at the state that holds its string. The
tokens that end at a prefix are then those at the prefix's state and on the way along its suffix links. One of them is taken if it is
compatible with the last token of the prefix before it, that is, if encoding the two tokens together gives the two tokens.
Back-pointers then spell the ids.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .textkit import tidy

NAME = "word_bpe_49k.json"
#: Words of each of two generations whose encoding a worker keeps. Only speed depends on it.
CACHE_WORDS = 300_000
#: Pairs of tokens whose test a worker keeps; then it begins anew.
CACHE_PAIRS = 1_000_000
#: Letters that one suffix automaton is built over, so that its memory is bounded; longer words go through it in overlapping windows.
CHUNK_LETTERS = 20_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 stands for itself, the other bytes for U+0100 on."""
    plain = {b for b in range(256) if chr(b).isprintable() and chr(b) not in " \xa0\xad" and b < 256 and not 0x7F <= b < 0xA1}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Stands for the word end in the automaton's strings; no letter of byte_letters().
END = "\uf8ff"
#: A trie node's token and its length stand under this key, which is no letter.
TOKEN = ""

Trie = dict[str, "Trie | tuple[int, int]"]


class SuffixAutomaton:
    """The suffix automaton of several strings: its states are the sets of substrings with the same ends.

    A string's prefix is the longest substring of its own state, and all suffixes of the prefix lie on the way along suffix links.
    """

    def __init__(self, strings: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.longest = [-1], [0]
        #: Of each string the state of every prefix, the empty one first.
        self.prefixes: list[list[int]] = []
        edges, link, longest = self.next, self.link, self.longest
        for string in strings:
            at, states = 0, [0]
            for letter in string:
                to = edges[at].get(letter)
                if to is not None:  # known from another string
                    at = to if longest[to] == longest[at] + 1 else self._split(at, to, letter)
                else:
                    made, up = len(link), at
                    longest.append(longest[at] + 1)
                    edges.append({})
                    link.append(0)
                    while up >= 0:
                        to = edges[up].setdefault(letter, made)
                        if to != made:
                            link[made] = to if longest[to] == longest[up] + 1 else self._split(up, to, letter)
                            break
                        up = link[up]
                    at = made
                states.append(at)
            self.prefixes.append(states)

    def _split(self, at: int, to: int, letter: str) -> int:
        """A state of its own for the longest string of `at` with the letter, split off the state `to` of longer ones."""
        edges, link, split = self.next, self.link, len(self.link)
        self.longest.append(self.longest[at] + 1)
        edges.append(edges[to].copy())
        link.append(link[to])
        link[to] = split
        while at >= 0 and edges[at].get(letter) == to:
            edges[at][letter] = split
            at = link[at]
        return split

    def place(self, trie: Trie) -> None:
        """Walk a trie of strings through the automaton, and note for every state the (length, token) of all of them that are suffixes of its longest string."""
        edges, link = self.next, self.link
        marks: dict[int, tuple[tuple[int, int], ...]] = {}
        open_ = [(trie, 0)]
        while open_:
            node, state = open_.pop()
            for letter, to in edges[state].items():
                below = node.get(letter)
                if below is not None:
                    if TOKEN in below:
                        marks[to] = (*marks.get(to, ()), below[TOKEN])
                    if len(below) > (TOKEN in below):
                        open_.append((below, to))
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(link)
        for state in sorted(range(1, len(link)), key=self.longest.__getitem__):
            own, more = marks.get(state), self.ending[link[state]]
            self.ending[state] = more if own is None else own + more


class WordBpe:
    """A tokenizer of the word_bpe kind: NFC, white space collapsed, lower-cased, split by pattern, BPE with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.table = {b: c for b, c in enumerate(self.letters)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for order, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = self.vocab[a + b]
            self.rank[self.vocab[a], self.vocab[b]] = (order, made)
            self.parts.setdefault(made, (self.vocab[a], self.vocab[b]))
        self.fits: dict[int, bool] = {}
        self.seen: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        # a token counts only if its own string is encoded as it: others can't occur in any encoding
        base = [self.vocab[c + e] for c in self.letters for e in ("", self.end)]
        self.alone = set(base)
        tokens = {self.flat(i): i for i in base}
        for made, (a, b) in self.parts.items():
            if a in self.alone and b in self.alone and self.compatible(a, b, self.rank[a, b][0]):
                self.alone.add(made)
                tokens[self.flat(made)] = made
        self.trie: Trie = {}
        self.widest = max(map(len, tokens))
        for string, i in tokens.items():
            node = self.trie
            for letter in string:
                node = node.setdefault(letter, {})
            node[TOKEN] = (len(string), i)

    def flat(self, token: int) -> str:
        s = self.strings[token]
        return s[: -len(self.end)] + END if s.endswith(self.end) and len(s) > len(self.end) else s

    def compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether a then b stay two tokens when encoded together; with a limit, until the merge of that order.

        Undo the later of the two tokens' merges, again and again, always at the border; a merge across the border that
        would come before the merge undone (left goes first on a tie) breaks the pair.
        """
        far = len(self.rank) + 1 if limit is None else limit
        while True:
            across = self.rank.get((a, b))
            if across is not None and across[0] < far:
                return False
            la, lb = self.order(a), self.order(b)
            if la < 0 and lb < 0:
                return True
            if la > lb:
                far, a = la, self.parts[a][1]
            else:  # of two equal merges the left one goes first, so that one across the border would break b's
                far, b = lb + 1, self.parts[b][0]

    def order(self, t: int) -> int:
        return self.rank[self.parts[t]][0] if t in self.parts else -1

    def encode_words(self, words: Iterable[str]) -> Iterator[list[int]]:
        """ids of each word. Words share suffix automata of a bounded number of letters each."""
        held: list[str] = []
        size = 0
        for word in words:
            string = "".join([self.letters[b] for b in word.encode()]) + END
            if held and size + len(string) > CHUNK_LETTERS:
                yield from self._together(held)
                held, size = [], 0
            held.append(string)
            size += len(string)
        if held:
            yield from self._together(held)

    def _together(self, strings: list[str]) -> Iterator[list[int]]:
        if len(strings) == 1 and len(strings[0]) > CHUNK_LETTERS:
            yield self._spell(strings[0], self._windows(strings[0]))
            return
        automaton = SuffixAutomaton(strings)
        automaton.place(self.trie)
        for string, states in zip(strings, automaton.prefixes, strict=True):
            yield self._spell(string, map(automaton.ending.__getitem__, states[1:]))

    def _windows(self, string: str) -> Iterator[Iterable[tuple[int, int]]]:
        """What ends at each prefix of a long string: windows begin so far before their first end that every token fits in."""
        for first in range(0, len(string), CHUNK_LETTERS):
            begin = max(0, first + 1 - self.widest)
            automaton = SuffixAutomaton([string[begin : first + CHUNK_LETTERS]])
            automaton.place(self.trie)
            yield from map(automaton.ending.__getitem__, automaton.prefixes[0][first - begin + 1 :])

    def _spell(self, string: str, matches: Iterable[Iterable[tuple[int, int]]]) -> list[int]:
        """The last token of every prefix, from what matches there; then the ids along the back-pointers."""
        n, fits = len(string), self.fits
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for i, ending in enumerate(matches, 1):
            if i == n - 1:  # the last letter stands with the word end only
                continue
            for size, token in ending:
                j = i - size
                if j:
                    before = last[j]
                    if before < 0:
                        continue
                    ok = fits.get(before << 32 | token)
                    if ok is None:
                        if len(fits) >= CACHE_PAIRS:
                            fits.clear()
                        ok = fits[before << 32 | token] = self.compatible(before, token)
                    if not ok:
                        continue
                last[i], back[i] = token, j
                break
        ids, i = [], n
        while i:
            ids.append(last[i])
            i = back[i]
        return ids[::-1]

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter. White space needn't be collapsed, as the pattern takes none of it."""
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def learn(self, words: Iterable[str]) -> dict[str, tuple[str, int, str]]:
        """Of words that aren't in the newer generation: ids as text, their number, and the decoded text."""
        out = {w: self.older[w] for w in words if w in self.older}
        fresh = [w for w in words if w not in out]
        for word, ids in zip(fresh, self.encode_words(fresh), strict=True):
            out[word] = (" ".join(map(str, ids)), len(ids), " ".join([self.strings[i] for i in ids]))
        for word, got in out.items():
            if len(self.seen) >= CACHE_WORDS:
                self.seen, self.older = {}, self.seen
            self.seen[word] = got
        return out

    def digest(self, text: str) -> tuple[str, int, str]:
        """ids joined by spaces, their number, decoded text."""
        pieces = self.cutter.split(text) if self.cutter and "<|" in text else [text]
        found: list[tuple[str, int, str]] = []
        for piece in pieces:
            if piece in self.special:
                found.append((str(self.special[piece]), 1, piece))
            elif piece:
                words = self.pattern.findall(self.normal(piece))
                got = list(map(self.seen.get, words))
                if None in got:
                    fresh = self.learn(dict.fromkeys(w for x, w in zip(got, words, strict=True) if x is None))
                    got = [x or fresh[w] for x, w in zip(got, words, strict=True)]
                found += got
        if not found:
            return "", 0, ""
        ids, n, strings = zip(*found, strict=True)
        return " ".join(ids), sum(n), " ".join(strings)

    def encode(self, text: str) -> list[int]:
        ids = self.digest(text)[0]
        return [int(x) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, as the vocabulary file names no decoder."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def vocabulary(name: str = NAME) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a vocabulary file, built once in each Python process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe(docs: DataFrame, path: str | None = None, *, with_ids: bool = False) -> DataFrame:
    """All columns of docs, and n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if asked for).

    ids are those of the vocabulary file's tokenizer without added tokens; strings of its special tokens inside a text are
    those tokens. ids_sha256 hashes the decimal ids joined by one space, decoded_sha256 the text decoded from them. Null and
    empty texts have no tokens. Rows are independent, so repeated rows and any doc_id are fine; columns of docs with
    the names of new ones are replaced. Very long texts are encoded whole, one at a time, and very long words in windows. No rows give no rows. Each worker loads the vocabulary file, about 2 MB, by its path.
    """
    path = path or vocabulary()
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if with_ids else {})
    old = [c for c in docs.columns if c not in new]
    docs = docs.select(*[f"`{c}`" for c in old])
    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            n, ids, texts, raw = [], [], [], []
            for text in batch.column("text"):
                a, k, b = own.digest(text.as_py() or "")
                n.append(k)
                ids.append(sha256(a.encode()).hexdigest())
                texts.append(sha256(b.encode()).hexdigest())
                if with_ids:
                    raw.append(([int(x) for x in a.split()], b))
            cols = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
            if with_ids:
                cols += [pa.array([x[0] for x in raw], pa.list_(pa.int32())), pa.array([x[1] for x in raw], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *new])

    return docs.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
