"""Reuse of answers, rolling windows, one task for each shard, a clash of conversation numbers, and very long texts."""

import random

import numpy as np

from meshql.llm import bpe, chat_format, decontaminate, hilbert, jaccard, kneser_ney, line_dedup, repetition, shared, toxicity
from meshql.llm import textkit as K


def test_derived_answers_are_exact():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 3000).astype(np.uint64)
    found = {}
    for i in range(40):
        keep = base[r.random(3000) < (0.95 if i % 4 else 0.3)]
        found[i] = np.unique(np.concatenate([keep, r.integers(0, 2**63, 100).astype(np.uint64)]))
    found[40], found[41] = found[3][:50], np.zeros(0, np.uint64)
    answers = jaccard._Answers(found)
    for x in range(41):
        for y in range(x + 1, 41):
            assert answers.overlap(x, y) == len(np.intersect1d(found[x], found[y]))
    assert answers.derived > 200


def test_rolling_windows():
    r = np.random.default_rng(2)
    words, bounds = K.mix(r.integers(0, 3, 400).astype(np.uint64)), np.array([0, 0, 3, 150, 151, 400, 400])
    rolling = K.Windows(words, bounds)
    for n in (1, 3, 5, 10):
        keys, at = rolling.of(n)
        want = [i for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b - n + 1)]
        assert at.tolist() == want
        seen = {}
        for k, i in zip(keys.tolist(), want, strict=True):
            assert seen.setdefault(tuple(words[i : i + n].tolist()), k) == k
        assert len(set(seen.values())) == len(seen)


def test_power_tables_stay_small():
    data = np.zeros(5 * K.CHUNK_BYTES, dtype=np.uint8)
    K.span_hashes(data, np.array([0]), np.array([len(data)]))
    assert len(K._pow) <= 2 * K.CHUNK_BYTES + 1 and len(K._inv) <= 2 * K.CHUNK_BYTES + 1


def test_a_shard_is_a_task(spark):
    df = shared.sharded(spark.range(1000).selectExpr("cast(id % 16 as int) as shard"), "shard", 16)
    assert df.rdd.glom().map(lambda rows: len({r["shard"] for r in rows})).collect() == [1] * 16
    plan = df.groupBy("shard").applyInArrow(lambda t: t, "shard int")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_conversation_with_the_added_number(spark, tmp_path):
    rows = [(-7, 0, "user", "own"), (-7, 1, "assistant", "answer"), (1, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat_format.query(spark, str(tmp_path)).collect())
    assert got == [(-7, 2, len("answer")), (-7, 2, len(r"\### Assistant: </turn> ok")), (1, 1, 0)]


def test_very_long_texts(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(5000)]
    long = "\n".join(" ".join(r.choices(words, k=40)) for _ in range(9000))
    item = " ".join(r.choices(words, k=30))
    assert len(long) > 2_000_000
    docs = spark.createDataFrame([(1, long), (2, long + "\n" + item), (3, "short text"), (4, None)], "doc_id long, text string").repartition(2).cache()
    found = {x["doc_id"]: x for x in jaccard.near_components(docs).collect()}
    assert found[1]["component_id"] == found[2]["component_id"] == 1 and found[1]["n_shingles"] > 300_000 and found[4]["n_shingles"] == 0
    measured = {x["doc_id"]: x for x in repetition.repetition(docs).collect()}
    assert measured[1]["n_words"] == 360_000 and measured[1]["kept"] and not measured[3]["kept"]
    assert {(x["doc_id"], x["n_covered"]) for x in decontaminate.matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()} == {(2, 30)}
    tokens = {x["doc_id"]: x["n_tokens"] for x in bpe.bpe(docs).collect()}
    assert tokens[1] > 360_000 and tokens[4] == 0
    scored = {x["doc_id"]: x for x in kneser_ney.perplexity(docs).collect()}
    assert scored[1]["n_tokens"] == 360_001 and scored[4]["n_tokens"] == 1 and scored[1]["score"] < 0
    kept = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs).collect()}
    assert kept[1]["n_lines"] == 9000
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).score(docs).count() == 4


def test_hilbert_takes_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 3_000_000, "en", "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    got = hilbert.hilbert_shards(docs).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {1: 3_000_001, 2: 1}
