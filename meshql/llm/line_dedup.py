"""Line deduplication: explode normalised lines, hash them, count distinct documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Bound on the keys that are broadcast because many documents hold them.
HOT_KEYS = 1000
#: The white space that is stripped, and the letters that are lower-cased.
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop from every text the lines that many documents hold, but for one document.

    A line's key is the line stripped of `[\\x20\\x09-\\x0D]` with A-Z lower-cased. Keys of at least `min_chars` code
    points found in at least `min_docs` distinct doc_id keep their lines only in the largest doc_id that holds them.
    Returns all columns of docs with `text` replaced by what is kept, and n_lines, n_dropped.

    Null and empty texts are one empty line. A null doc_id counts as one document, smaller than any other. Rows that
    share a doc_id count as one document and are each treated by its keys; equal rows give equal rows. An empty table
    gives an empty table. Columns of docs named n_lines or n_dropped are replaced; others pass through.
    """
    old = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce("text", F.lit(""))
    # the row's own columns travel in a struct, so that their names can't clash with those used here
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in old if c != "text"]).alias("_row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_doc"), F.xxhash64(text).alias("_sum"))
    lines = (
        base.select("_doc", "_sum", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("_pos", "_line"))
        .select("_doc", "_sum", "_pos", F.btrim(F.translate("_line", UPPER, LOWER), F.lit(STRIP)).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_doc", "_sum", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(1), "_key").alias("_k2"))
    )
    # one row for each key and document first: a key that a third of all documents hold is spread by document
    held = lines.groupBy("_k1", "_k2", "_doc").agg(F.lit(1).alias("_one"))
    common = held.groupBy("_k1", "_k2").agg(F.count("_one").alias("_n"), F.max("_doc").alias("_last")).where(F.col("_n") >= min_docs)
    # the keys that most documents hold, HOT_KEYS of them at most, are looked up by broadcast; their lines then go to the join under
    # keys of their own that match nothing, so that no task gets all lines of one key
    hot = common.orderBy(F.desc("_n"), "_k1", "_k2").limit(HOT_KEYS).select("_k1", "_k2", F.col("_last").alias("_hot"))
    tagged = lines.join(F.broadcast(hot), ["_k1", "_k2"], "left").withColumn("_k1", F.when(F.col("_hot").isNull(), F.col("_k1")).otherwise(F.xxhash64("_doc", "_pos")))
    drops = (
        tagged.join(common.select("_k1", "_k2", "_last"), ["_k1", "_k2"], "left")
        .where(F.col("_doc") != F.coalesce("_hot", "_last"))
        .groupBy("_doc", "_sum")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    # the split stands below the join, so that the lines are an array at hand when they are picked by position
    split = base.select("_row", "_doc", "_sum", F.split(text, "\n", -1).alias("_lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop")), lambda i: F.get("_lines", i))
    whole = F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(kept, "\n"))
    return split.join(drops, ["_doc", "_sum"], "left").select(
        *[whole.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in old],
        F.size("_lines").cast("long").alias("n_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         trim(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), c AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), k AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.last AS dropped FROM l LEFT JOIN c ON l.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
