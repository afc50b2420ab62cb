import random

import pytest

import corpus_pipeline
from corpusloom.llm import secrets


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(30)
    rows = [(i, text(60), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, f"{text(20)} idiot scum idiot {text(20)} scum", "en", "s", 0) for i in range(30)]
    rows += [(200, rows[0][1], "en", "s", 0), (201, rows[0][1].upper(), "en", "s", 0)]
    rows += [(300, f"{text(10)} {item} {text(10)}", "en", "s", 0), (301, f"{text(30)} token = 0123456789abcdef01 {text(5)}", "en", "s", 0)]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, " ", "en", "s", 0), (None, text(40), "en", "s", 5), (301, rows[-1][1], "en", "s", 0)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect_and_keep_clean_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables).cache()
        left[name] = sorted((r.doc_id for r in docs.collect()), key=str)
        if name != "bpe":
            assert docs.columns == columns
        if name == "secrets":
            assert "token" not in docs.where("doc_id = 301").first().text
            assert docs.where("doc_id = 5").first().text.startswith("w")
    assert not any(i and 100 <= i < 130 for i in left["toxicity"]) and set(range(60)) <= set(left["toxicity"])
    assert set(range(60)) <= set(left["near_dedup"]) and not {200, 201, 401, 402} & set(left["near_dedup"]) and left["near_dedup"].count(301) == 1
    assert 300 not in left["decontamination"] and {301, 400, None} <= set(left["decontamination"])
    assert left["bpe"] == left["secrets"] == left["decontamination"]
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, tables).collect()), key=str) == left["bpe"]


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
        assert docs.count() == 0


def test_redaction_is_what_the_scan_reports(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    changed = {r.doc_id for r in docs.alias("a").join(secrets.redact(docs).alias("b"), "doc_id").where("a.text <> b.text").select("doc_id").collect()}
    assert changed == {r.doc_id for r in secrets.report(secrets.scan(docs)).where("spans <> ''").collect()} == {301}
