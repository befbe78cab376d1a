"""Chat formatting by Spark expressions alone: sort collected turns, merge neighbours of one role, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: The template. A block is one turn or several adjacent turns of one role.
OPEN, HEAD_END, PART, CLOSE = "<turn=", ">\n", "<part/>", "</turn>\n"


def escape(c: Column) -> Column:
    """No < or > is left, so that no control string can stand inside a text; unescape() undoes it."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def format_chats(conversations: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss_spans array<struct<start, end>>, n_blocks.

    Turns are sorted by turn, then role, then text; adjacent turns of one role share a block, with `<part/>` between their
    texts. loss_spans are code-point ranges of `formatted`: one for each text of loss_role, markers left out.
    A null text or role is an empty string; a null turn sorts first; rows with a null conv_id form one conversation;
    repeated rows are repeated turns. No rows give no rows. Further columns are ignored.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def merge(acc: Column, t: Column) -> Column:
        """acc: blocks that are closed, and the open one."""
        more = F.struct(acc["done"].alias("done"), acc["role"].alias("role"), F.concat(acc["texts"], F.array(escape(t["text"]))).alias("texts"))
        fresh = F.struct(
            F.when(acc["role"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["role"].alias("role"), acc["texts"].alias("texts"))))).alias("done"),
            t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"),
        )
        return F.when(acc["role"] == t["role"], more).otherwise(fresh)

    texts = "array<string>"
    zero = F.struct(F.array().cast(f"array<struct<role:string,texts:{texts}>>").alias("done"), F.lit(None).cast("string").alias("role"), F.array().cast(texts).alias("texts"))
    blocks = F.aggregate("turns", zero, merge, lambda a: F.concat(a["done"], F.array(F.struct(a["role"].alias("role"), a["texts"].alias("texts")))))
    merged = turns.select("conv_id", blocks.alias("blocks"))

    def head(b: Column) -> Column:
        return F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD_END))

    def spans(acc: Column, b: Column) -> Column:
        """Move over a block's head, its texts and its end; keep the texts' ranges if the role is trained on."""
        inner = F.aggregate(
            b["texts"], F.struct((acc["at"] + F.length(head(b))).alias("at"), acc["spans"].alias("spans")),
            lambda x, s: F.struct(
                (x["at"] + F.length(s) + F.lit(len(PART))).alias("at"),
                F.when(b["role"] == loss_role, F.concat(x["spans"], F.array(F.struct(x["at"].alias("start"), (x["at"] + F.length(s)).alias("end"))))).otherwise(x["spans"]).alias("spans"),
            ),
        )
        return F.struct((inner["at"] + F.lit(len(CLOSE) - len(PART))).alias("at"), inner["spans"].alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    body = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], PART), F.lit(CLOSE)))
    return merged.select(
        "conv_id", F.array_join(body, "").alias("formatted"), F.aggregate("blocks", start, spans, lambda a: a["spans"]).alias("loss_spans"), F.size("blocks").cast("long").alias("n_blocks")
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, turn by turn."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")

    def parts(b: Column) -> Column:
        role = unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), HEAD_END, 1))
        texts = F.split(F.substr(b, F.locate(HEAD_END, b) + F.lit(len(HEAD_END))), PART, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    out = format_chats(chats).unionByName(format_chats(planted))  # apart from a conversation of the table that has its number
    read = out.select("*", read_back(F.col("formatted")).alias("read"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', true
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', true
), b AS (
  SELECT *, (lag(role) OVER (PARTITION BY conv_id, added ORDER BY turn, role, text) IS DISTINCT FROM role)::INT AS fresh,
         length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) + 3 * (length(text) - length(replace(text, '>', ''))) AS n_esc
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n_esc) + sum(CASE WHEN fresh = 1 THEN 16 + length(role) ELSE 7 END))::BIGINT AS formatted_chars,
       sum(fresh)::BIGINT AS n_blocks
FROM b GROUP BY conv_id, added
"""
