"""The corpus pipeline against the operators' brute-force versions, one stage after another."""

import random

import pytest

import corpus_pipeline
from meshql.llm import bpe, decontaminate, toxicity
from meshql.llm.queries import ORACLE_SQL, QUERIES

from .test_page_label_chat import made_corpus
from .test_text_ops import components_by_hand, dedup_by_hand

ITEM = " ".join(made_corpus(2, 77)[0][1][1].split()[:20])
FILL = " ".join(made_corpus(2, 78)[0][1][1].split()[:19]) + " "
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts, labels = made_corpus(400, 5)
    r = random.Random(2)
    shared = "this line stands in very many documents of the corpus"
    rows = [(i, t + (f"\n{shared}\nend {i}" if i % 5 == 0 else "")) for i, t in texts]
    rows += [(1000 + i, rows[i][1]) for i in range(1, 60, 2)]
    for i in range(60):
        w = rows[4 * i + 1][1].split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000 + i, f"{FILL}{i} {ITEM} and {i} more") for i in range(5)] + [(4000, None), (4001, ""), (4002, "short"), (None, "a text without an id")]
    spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = [tuple(r) for r in docs.collect()]
        texts = sorted(((r[0], r[1]) for r in after), key=str)
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            toxic = {r["row"]["doc_id"] for r in model.score(spark.read.parquet(f"{folder}/documents.parquet")).where("predicted = 1").collect()}
            assert sorted(after, key=str) == sorted((r for r in before if r[0] not in toxic), key=str) and 60 < len(toxic) < 200
        elif name == "line_dedup":
            assert texts == sorted(((i, t) for i, t, *_ in dedup_by_hand([r[:2] for r in before])), key=str)
            assert all(r[4] == len(r[1]) for r in after) and any(a[1] != b[1] for a, b in zip(sorted(before, key=str), sorted(after, key=str), strict=True))
        elif name == "near_duplicates":
            kept = {i for i, _, c in components_by_hand([r[:2] for r in before]) if i == c}
            assert sorted(after, key=str) == sorted((r for r in before if r[0] in kept), key=str) and len(after) < len(before) - 50
        elif name == "decontamination":
            assert {r[0] for r in before} - {r[0] for r in after} == {3000} | {i for i in range(3001, 3005) if i in {r[0] for r in before}}
        else:
            own = bpe.tokenizer(bpe.vocabulary())
            assert len(after) == len(before) and docs.columns[: len(columns)] == columns
            assert all(r[5] == len(own.encode(r[1] or "")) for r in after)
        if name != "bpe":
            assert docs.columns == columns
        before = after


def test_run_equals_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 150 and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert decontaminate.matches(got, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0


def test_without_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", -1)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.drop_contaminated(spark, docs, folder).count() == docs.count() - 5


def test_empty_documents(spark, folder, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 13)) and set(ORACLE_SQL) < set(QUERIES)
