"""The corpus pipeline's stages on the small tables and on odd rows."""

import os
import re
import subprocess
import sys

import pytest

import corpus_pipeline as p
from tessella.llm import pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_entry_imports_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'pipeline' in e.queries() and e.oracle_sql()"], cwd=os.path.dirname(p.__file__), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_stages_are_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_copies", "repeated_passages", "personal_data", "packing"]
    assert p.ORACLE_SQL is None


def test_toxicity_drops_what_scores_high(spark, sf_dir, documents):
    kept = p.drop_toxic(spark, documents, sf_dir)
    assert kept.columns == COLUMNS
    index = toxicity.fit(toxicity.bounded_sample(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(documents, index).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


def test_one_near_copy_stays(spark, sf_dir, documents):
    kept = p.drop_near_copies(spark, documents, sf_dir)
    assert kept.columns == COLUMNS
    words = {r["doc_id"]: re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "").encode().split() for r in documents.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    linked = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    label = {i: i for i in sorted(sets)}
    pairs = [(i, j) for i in label for j in label if i < j and linked(i, j)]
    while True:
        new = dict(label)
        for i, j in pairs:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            break
        label = new
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*label.values()})
    assert len(kept.collect()) < len(sets)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
    rows = [(1, None, None, None, None, 1.0, "x"), (None, "", "en", "s", 0, 1.0, "x"), (2, "same words here", "en", "s", 1, 0.0, "x"), (2, "same words here", "en", "s", 1, 0.0, "x"), (3, "a@b.example.com é" * 5, "en", "s", 1, 0.0, "x")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect())[:3] == [(False, 1), (False, 2), (False, 3)]
    assert not any("@" in (r["text"] or "") for r in docs.collect())
    assert p.pack(spark, docs, sf_dir).count() >= 4
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_personal_data_is_replaced(spark, sf_dir, documents):
    hidden = {r["doc_id"]: r for r in p.hide_personal_data(spark, documents, sf_dir).collect()}
    for r in documents.collect():
        base, now = pii.base_spans(r["text"]), hidden[r["doc_id"]]
        assert now["n_chars"] == len(now["text"])
        if not base:
            assert now["text"] == r["text"]
        assert len(re.findall("<(?:email|ip|card|phone)>", now["text"])) >= min(1, len(base))


def test_run_packs_what_is_left(spark, sf_dir, documents):
    got = p.run(spark, sf_dir).toPandas()
    assert set(got["doc_id"]) <= {r["doc_id"] for r in documents.collect()}
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()
