"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths over whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as K
from .shared import table

#: The published limits for the share of word characters inside duplicated n-grams, by n, in hundredths.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: ... and for the share of the lines' characters in lines that occurred before, in hundredths.
LINE_CHARS_LIMIT = 20

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in NGRAM_LIMITS)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of SCHEMA for a chunk of texts."""
    starts, ends, bounds = K.word_spans(data, offsets)
    words = K.span_hashes(data, starts, ends)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    chars = points[ends] - points[starts]
    n_words = np.diff(bounds)
    out = {"n_words": n_words, "word_chars": _sums(chars, bounds), "n_symbols": _sums(SYMBOL[data], offsets)}

    rolling = K.Windows(words, bounds)

    def in_repeats(n: int, later_only: bool) -> np.ndarray:
        keys, at = rolling.of(n)
        again, later = K.repeated(keys, rolling.rows[at])
        return K.covered(at[later if later_only else again], n, len(words))

    out["n_repeat_words"] = _sums(in_repeats(3, False), bounds)
    breaks = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    last = np.sort(np.concatenate([offsets[1:], breaks]))
    held = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[held], last[held]
    rows = K.rows_of(first, offsets)
    _, later = K.repeated(K.span_hashes(data, first, last), rows)
    n = len(offsets) - 1
    out["n_dup_lines"] = np.bincount(rows[later], minlength=n)
    size = points[last] - points[first]
    out["dup_line_chars"] = np.bincount(rows[later], weights=size[later], minlength=n).astype(np.int64)
    failed = 100 * out["dup_line_chars"] > LINE_CHARS_LIMIT * np.bincount(rows, weights=size, minlength=n).astype(np.int64)
    for k, limit in NGRAM_LIMITS.items():
        out[f"dup_chars_{k}"] = _sums(np.where(in_repeats(k, True), chars, 0), bounds)
        failed |= 100 * out[f"dup_chars_{k}"] > limit * out["word_chars"]
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    out["kept"] = ~out["base_failed"] & ~failed
    return out


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of SCHEMA, one row per document; verdict `kept`.

    Kept texts pass the base rules (50 words at least, at most half of the words in repeated 3-word windows) and every
    limit on duplicated lines and on characters inside n-grams of 5 to 10 words that occurred before in the text. Null and
    empty texts have no words and fail. doc_id may be null or repeated: each row is judged by its own text. Very long texts are judged
    whole, with some tens of bytes of temporaries for each of theirs. No rows give no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column("text")):
                found = measure(data, offsets)
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(found[k]) for k in names)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(K.tidy(run), f"doc_id long, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL for the query's rows: words and lines by position, windows as joined words, covered places counted once."""
    space = r"[\x20\x09-\x0D]"
    covers = "".join(
        f""",
g{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS g FROM e) WHERE i + {n - 1} <= n),
d{n} AS (SELECT e.doc_id, {'count(*)' if n == 3 else 'sum(length(e.word))'} AS v FROM e JOIN (SELECT DISTINCT doc_id, i + unnest(range({n})) AS p FROM g{n} WHERE {'c' if n == 3 else 'k'} > 1) x ON x.doc_id = e.doc_id AND x.p = e.i GROUP BY e.doc_id)"""
        for n in (3, *NGRAM_LIMITS)
    )
    joins = "".join(f" LEFT JOIN d{n} ON d{n}.doc_id = w.doc_id" for n in (3, *NGRAM_LIMITS))
    chars = ", ".join(f"coalesce(d{n}.v, 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_LIMITS)
    limits = " AND ".join(f"100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in NGRAM_LIMITS.items())
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, [x FOR x IN string_split_regex(coalesce(text, ''), '{space}+') IF x <> ''] AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w),
l AS (SELECT doc_id, ls[j] AS line, row_number() OVER (PARTITION BY doc_id, ls[j] ORDER BY j) AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS j FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM w)) WHERE regexp_matches(ls[j], '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) FILTER (k > 1) AS n, coalesce(sum(length(line)) FILTER (k > 1), 0) AS c, sum(length(line)) AS a FROM l GROUP BY doc_id){covers},
r AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
  coalesce(d3.v, 0)::BIGINT AS n_repeat_words, coalesce(dl.c, 0)::BIGINT AS dup_line_chars, coalesce(dl.a, 0) AS line_chars, {chars} FROM w LEFT JOIN dl ON dl.doc_id = w.doc_id{joins})
SELECT * EXCLUDE (line_chars), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * dup_line_chars <= {LINE_CHARS_LIMIT} * line_chars AND {limits} AS kept FROM r
"""


ORACLE = _oracle()
