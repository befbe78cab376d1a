"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; windows of the canonical tokens of documents and of benchmark items are
joined by hash; along each alignment of a document with an item a value of the item must stand for one value of the document
wherever it occurs. So a passage is found as it is, and also with other numbers, names or units put in, which may coincide.
Windows of the folded words themselves are joined too, whatever their slots: a capital isn't evidence of a name where all words
have one. In passages of capitals alone names can't be told from other words, so that windows that hold another name aren't
found there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .shared import cut, table

#: Tokens of a window, and how many of them must be plain words if it is matched as a template. SPARSE holds for items that have no such window:
#: those of fewer tokens, which are one window of their own length, and those dense in slots.
WINDOW, PLAIN, SPARSE = 8, 5, 3
#: Share of an item's tokens, in hundredths, that matched windows must cover.
COVER = 50
#: Up to so many hashes of 8 bytes are sent to every worker to sift the documents' windows; with more, all windows are joined.
BROADCAST_WINDOWS = 2_000_000
#: Up to so many windows of the benchmark, of about 100 bytes each, are themselves sent; more are joined by shuffle, where hot ones are split.
BROADCAST_ITEMS = 200_000

#: Units, as they stand after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ounce ounces pound pounds gram grams kilogram kilograms ton tons tonne tonnes "
    "ml cl l litre litres liter liters gal gallon gallons pint pints cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "metre metres meter meters kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters percent degree degrees "
    "dollar dollars euro euros cent cents usd eur gbp hz khz mhz w kw v a kb mb gb tb mph kph"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))

EDGE = np.ones(256, dtype=bool)  # bytes stripped from both ends of a word: all ASCII but letters and digits
EDGE[48:58] = EDGE[65:91] = EDGE[97:123] = EDGE[128:] = False
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
NUMERIC = DIGIT.copy()
NUMERIC[list(b".,:/-")] = True


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(K.span_hashes(data, np.concatenate([[0], ends[:-1]]), ends))


UNIT_HASHES = _hashes(UNITS)


def _within(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mask of x in the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's tokens: canonical hash, hash of the word itself, whether it is a slot; and each row's first token (n + 1).

    Words lose what isn't a letter or digit at both ends; words with nothing left are no tokens. Words of digits are numbers, a unit right after a
    number is a unit, words that begin with a capital are names.
    """
    starts, ends, bounds = K.word_spans(data, offsets)
    solid = np.concatenate([[0], np.cumsum(~EDGE[data])])
    held = np.flatnonzero(solid[ends] > solid[starts])
    places = np.flatnonzero(~EDGE[data])
    starts, ends = places[solid[starts[held]]], places[solid[ends[held]] - 1] + 1
    bounds = np.searchsorted(held, bounds)
    low = K.fold(data)
    plain = K.span_hashes(low, starts, ends)
    numeric = np.concatenate([[0], np.cumsum(NUMERIC[data])])
    number = DIGIT[data[starts]] & (numeric[ends] - numeric[starts] == ends - starts)
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)] if len(data) else first
    name = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    after_number = np.concatenate([[False], number[:-1]]) if len(number) else number
    row_start = bounds[:-1][bounds[:-1] < len(number)]
    after_number[row_start] = False
    unit = after_number & _within(UNIT_HASHES, plain)
    out = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, plain)))
    return out, plain, number | unit | name, bounds


def windows(found: tuple[np.ndarray, ...], size: int, least: int | np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, place in the row, hash, words of the window's slots (n, size), which of them are slots (n, size)), of wanted hashes only if given.

    Each window of a chunk's canonical tokens is given with the hash of its folded words and no slots. One with slots and at least `least` plain
    words (of all rows, or of each) is given again with its canonical hash.
    """
    tokens, words, slots, bounds = found
    keys, at = K.ngram_hashes(words, bounds, size)
    canon, _ = K.ngram_hashes(tokens, bounds, size)
    n_slots = slot_counts(found, size, at)
    few = (n_slots > 0) & (size - n_slots >= (least if np.isscalar(least) else least[K.rows_of(at, bounds)]))
    as_is = np.arange(len(at) + int(few.sum())) < len(at)
    keys, at = np.concatenate([keys, canon[few]]), np.concatenate([at, at[few]])
    if wanted is not None:
        hit = _within(wanted, keys)
        keys, at, as_is = keys[hit], at[hit], as_is[hit]
    rows = K.rows_of(at, bounds)
    near = at[:, None] + np.arange(size)
    return rows, at - bounds[rows], keys, words[near], slots[near] & ~as_is[:, None]


def slot_counts(found: tuple[np.ndarray, ...], size: int, at: np.ndarray) -> np.ndarray:
    filled = np.concatenate([[0], np.cumsum(found[2])])
    return filled[at + size] - filled[at]


def plain_needed(found: tuple[np.ndarray, ...], size: int, plain: int, sparse: int) -> np.ndarray:
    """Of each row, the plain words that its templates need: `plain` if any of its windows has so many, else `sparse`."""
    _, at = K.ngram_hashes(found[1], found[3], size)
    regular = np.zeros(len(found[3]) - 1, dtype=bool)
    regular[K.rows_of(at[size - slot_counts(found, size, at) >= plain], found[3])] = True
    return np.where(regular, plain, sparse)


def _emit(batch: pa.RecordBatch, id_column: str, rule: Rule, wanted: np.ndarray | None, short: list[int] | None) -> Iterator[pa.RecordBatch]:
    size = rule.window
    for a, b, data, offsets in K.chunks(batch.column("text")):
        found = canonical(data, offsets)
        n_tokens = np.diff(found[3])
        least = plain_needed(found, size, rule.plain, rule.sparse) if short is None else rule.sparse
        for n in [size, *(range(1, size) if short is None else short)]:
            if short is None and n < size and not (n_tokens == n).any():
                continue
            rows, place, keys, words, slots = windows(found, n, least if n == size else rule.sparse, wanted)
            if short is None and n < size:
                whole = n_tokens[rows] == n
                rows, place, keys, words, slots = rows[whole], place[whole], keys[whole], words[whole], slots[whole]
            each = np.concatenate([[0], np.cumsum(slots.sum(axis=1))]).astype(np.int32)
            fill = pa.ListArray.from_arrays(pa.array(each), pa.array(words[slots].view(np.int64)))
            ids = batch.column(id_column).slice(a, b - a).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(place.astype(np.int32)), pa.array(np.full(len(rows), n, dtype=np.int32)), pa.array(keys.view(np.int64)), fill], ["id", "place", "size", "key", "slots"])


SCHEMA = "id long, place int, size int, key long, slots array<long>"


@dataclass(frozen=True)
class Rule:
    window: int = WINDOW
    plain: int = PLAIN
    sparse: int = SPARSE


def _windows_of(df: DataFrame, id_column: str, rule: Rule, wanted: Broadcast | None = None, short: list[int] | None = None) -> DataFrame:
    """Windows of documents, of the regular size and of the lengths in short; without short those of items, with rows under one window as one of their own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _emit(batch, id_column, rule, None if wanted is None else wanted.value, short)

    return df.select(F.col(id_column).cast("long").alias(id_column), "text").mapInArrow(K.tidy(run), SCHEMA)


def _lengths(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a), pa.array(np.diff(canonical(data, offsets)[3]))], ["item_id", "n_tokens"])

    return df.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, n_tokens long")


def matches(docs: DataFrame, benchmark: DataFrame, *, rule: Rule = Rule(), cover: int = COVER, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_items: int = BROADCAST_ITEMS) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, same) of every document that holds a benchmark item.

    n_tokens: the item's tokens; n_covered: those inside matched windows, at least `cover` hundredths of them; same: whether all slots have the
    item's own values. Windows of the words as they are always count; templates count unless one of their slots has an item's value that stands for
    several of the document's along the alignment. An item under one window is one window of its own length, so that an item of one word is
    found wherever that word is. With other values, items need 5 plain words in a window of 8; those without such a window, and short ones, need 3:
    with fewer they are found only as they are. Null and empty texts match nothing; rows with a null doc_id or item_id are left out. Rows
    that share a doc_id count as one document, those that share an item_id as one item, with the longest row's token count. Very long texts are
    worked through whole, with some tens of bytes of temporaries for each of theirs. No documents or no items give no rows. Other columns, also
    those named like the ones made here, are left out.
    """
    docs, benchmark = docs.where("doc_id is not null"), benchmark.where("item_id is not null")
    items = cut(_windows_of(benchmark, "item_id", rule))
    n, wanted = items.count(), None
    if n <= broadcast_windows:
        keys = np.unique(items.select("key").distinct().toArrow()["key"].to_numpy()).view(np.uint64)
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(keys))
    lengths = _lengths(benchmark)
    short = sorted(r["n_tokens"] for r in lengths.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < rule.window)).select("n_tokens").distinct().collect())
    found = _windows_of(docs, "doc_id", rule, wanted, short)
    items = items.select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), "size", "key", F.col("slots").alias("item_slots"))
    if n <= min(broadcast_items, broadcast_windows):
        items = F.broadcast(items)
    pairs = found.drop("size").join(items, "key")
    fill = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    pairs = pairs.select(F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("item_place")).alias("shift"), F.struct("item_place", "size", fill.alias("fill")).alias("spot"))
    # an item has boundedly many windows, so an alignment is a small group
    aligned = pairs.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("spot").alias("spots"))
    values = aligned.withColumn("fill", F.array_distinct(F.flatten("spots.fill")))
    torn = F.transform(F.filter("fill", lambda x: F.exists("fill", lambda y: (y["i"] == x["i"]) & (y["d"] != x["d"]))), lambda x: x["i"])
    kept = values.withColumn("torn", torn).withColumn("spots", F.filter("spots", lambda p: ~F.exists(p["fill"], lambda x: F.array_contains("torn", x["i"]))))
    same = F.forall("spots", lambda p: F.forall(p["fill"], lambda x: x["i"] == x["d"]))
    whole = kept.select("doc_id", "item_id", "spots", same.alias("same")).groupBy("doc_id", "item_id").agg(F.flatten(F.collect_list("spots")).alias("spots"), F.min("same").alias("same"))
    inside = F.array_distinct(F.flatten(F.transform("spots", lambda p: F.sequence(p["item_place"], p["item_place"] + p["size"] - 1))))
    lengths = lengths.groupBy("item_id").agg(F.max("n_tokens").alias("n_tokens"))
    out = whole.select("doc_id", "item_id", F.size(inside).cast("long").alias("n_covered"), "same").join(lengths, "item_id")
    return out.where(F.col("n_covered") * 100 >= F.col("n_tokens") * cover).select("doc_id", "item_id", "n_tokens", "n_covered", "same")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH src AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
raw AS (SELECT kind, id, unnest(ws) AS word, unnest(range(len(ws))) AS j FROM (SELECT kind, id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM src)),
st AS (SELECT kind, id, j, regexp_replace(regexp_replace(word, '^[\x00-/:-@\[-`{{-\x7F]+', ''), '[\x00-/:-@\[-`{{-\x7F]+$', '') AS word FROM raw),
k AS (SELECT kind, id, row_number() OVER (PARTITION BY kind, id ORDER BY j) - 1 AS i, word FROM st WHERE word <> ''),
c AS (SELECT *, regexp_full_match(word, '[0-9][0-9.,:/-]*') AS num, regexp_matches(word, '^[A-ZÀ-ÖØ-Þ]') AS name, lower(word) AS low FROM k),
u AS (SELECT *, coalesce(lag(num) OVER (PARTITION BY kind, id ORDER BY i), false) AND low IN ({", ".join(f"'{x}'" for x in UNITS)}) AS unit FROM c),
t AS (SELECT kind, id, i, low, CASE WHEN num THEN '<n>' WHEN unit THEN '<u>' WHEN name THEN '<c>' ELSE low END AS tok, num OR unit OR name AS slot FROM u),
d AS (SELECT kind, id, list(tok ORDER BY i) AS toks, list(low ORDER BY i) AS lows, list(slot ORDER BY i) AS slots, count(*) AS n FROM t GROUP BY kind, id),
s AS (SELECT DISTINCT least(n, {WINDOW}) AS s FROM d WHERE kind = 'b' UNION SELECT {WINDOW}),
w AS (SELECT *, len(list_filter(sl, lambda x: x)) AS n_slots FROM (SELECT kind, id, n, s, i, array_to_string(lows[i + 1:i + s], ' ') AS lw, array_to_string(toks[i + 1:i + s], ' ') AS tw, lows[i + 1:i + s] AS lows, slots[i + 1:i + s] AS sl
  FROM (SELECT *, unnest(range(n - s + 1)) AS i FROM d JOIN s ON s.s <= n WHERE kind = 'd' OR s.s = least(n, {WINDOW})))),
need AS (SELECT id, CASE WHEN bool_or(s = {WINDOW} AND s - n_slots >= {PLAIN}) THEN {PLAIN} ELSE {SPARSE} END AS least FROM w WHERE kind = 'b' GROUP BY id),
b AS (SELECT w.*, n_slots > 0 AND s - n_slots >= least AS templ FROM w JOIN need USING (id) WHERE kind = 'b'),
m AS (SELECT d.id AS doc_id, b.id AS item_id, b.i AS place, b.s, d.i - b.i AS shift, CAST([] AS VARCHAR[]) AS il, CAST([] AS VARCHAR[]) AS dl FROM w d JOIN b ON d.s = b.s AND d.lw = b.lw WHERE d.kind = 'd'
  UNION ALL SELECT d.id, b.id, b.i, b.s, d.i - b.i, [v FOR v, k IN b.lows IF b.sl[k]], [v FOR v, k IN d.lows IF b.sl[k]] FROM w d JOIN b ON d.s = b.s AND d.tw = b.tw WHERE d.kind = 'd' AND templ),
p AS (SELECT DISTINCT doc_id, item_id, shift, unnest(il) AS iv, unnest(dl) AS dv FROM m),
torn AS (SELECT doc_id, item_id, shift, list(iv) AS vs FROM (SELECT doc_id, item_id, shift, iv FROM p GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT dv) > 1) GROUP BY 1, 2, 3),
good AS (SELECT m.* FROM m LEFT JOIN torn USING (doc_id, item_id, shift) WHERE vs IS NULL OR NOT list_has_any(il, vs)),
cov AS (SELECT doc_id, item_id, count(DISTINCT spot) AS n_covered, bool_and(il = dl) AS same FROM (SELECT doc_id, item_id, il, dl, place + unnest(range(s)) AS spot FROM good) GROUP BY 1, 2),
size AS (SELECT id AS item_id, count(*) AS n_tokens FROM k WHERE kind = 'b' GROUP BY id)
SELECT doc_id, cov.item_id, n_tokens, n_covered, same FROM cov JOIN size ON size.item_id = cov.item_id WHERE 100 * n_covered >= {COVER} * n_tokens
"""
