"""Near copies of the pipeline against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline as p
from tessella.llm import shingles

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("etaonrishdl") for _ in range(RNG.randint(2, 8))) for _ in range(300)]


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_heads(rows):
    """Smallest id of the group of each row."""
    sets = [plain_set(t) for _, t in rows]
    alike = [[a == b or 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    label = [i for i, _ in rows]
    while True:
        new = [min(label[j] for j in range(len(rows)) if alike[i][j]) for i in range(len(rows))]
        if new == label:
            return label
        label = new


def edited(text, n):
    words = text.split(" ")
    for i in RNG.sample(range(len(words)), n):
        words[i] = RNG.choice(WORDS)
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    texts = [None, "", " \n", "two words", "Two  words", "other words"]
    for n in (30, 120, 400):
        base = " ".join(RNG.choice(WORDS) for _ in range(n))
        texts += [base, *(edited(base, RNG.randint(1, max(1, n // 22))) for _ in range(25))]
        chain = base
        for _ in range(8):
            chain = edited(chain, max(1, n // 50))
            texts.append(chain)
    return list(enumerate(texts))


def test_near_copies_equal_brute_force(spark, copies):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in copies], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = plain_heads(copies)
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs).collect()}
    assert [got[i] for i, _ in copies] == want
    assert sorted(r["doc_id"] for r in p.drop_near_copies(spark, docs, "").collect()) == sorted(set(want))


def test_near_copies_of_the_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    kept = {r["doc_id"] for r in p.drop_near_copies(spark, docs, sf_dir).collect()}
    assert kept == set(plain_heads(rows))


def test_different_texts_under_one_id_both_stay(spark):
    a, b, c = (" ".join(RNG.choice(WORDS) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, a), (0, c), (1, c), (3, edited(b, 1)), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in p.drop_near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(0, c), (1, a), (1, b), (None, b)], key=str)


def test_blocks_of_large_buckets_give_the_same_components(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(shingles.shingles(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(texts))]
        if new == label:
            break
        label = new
    for tokens in (300, 1_000_000):
        monkeypatch.setattr(shingles, "BLOCK_TOKENS", tokens)
        got = {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs).collect()}
        assert got == dict(enumerate(label))
    assert 1 < len(set(label)) < len(texts)
