"""Packing, pieces, SimHash, personal data, toxicity and repeats against brute force on small tables."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash

from tessella.llm import packing, pieces, pii, queries, simhash, substrings, toxicity
from tessella.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, sequence_id long, fp string, component string"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("etaonrish") for _ in range(RNG.randint(1, 9))) for _ in range(400)]
PROSE = [" ".join(RNG.choice(WORDS) for _ in range(n)) for n in (1, 2, 3, 40, 90, 400, 1500)]
ODD = ["", " ", "\n\n\nword  \n ", "  a  b\n\n c ", "a　b \x1c c\x85d", "aaaaaaa", "日本語テスト 😀😀", "x" * 3000, "▁▁a ▁b", "don't we'll", "a\x00b", "ﬁ ½ Ǻ é", "A b C\tD"]


def documents(spark, texts, ids=None):
    """With extra columns whose names clash with those of results."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", 5, "f", "c") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    texts = [*ODD, *PROSE, None, None, PROSE[4], PROSE[4], PROSE[5]]
    ids = [*range(len(texts) - 2), None, len(texts) - 3]  # a null id, and a repeated id
    return documents(spark, texts, ids).repartition(3), list(zip(ids, texts))


def test_packing_covers_every_id_once(mixed):
    from tokenizers import Tokenizer

    table, rows = mixed
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(table).toPandas()
    want = sorted((-1 if i is None else i, tuple(reference.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    tokens = lambda ids: tuple(np.frombuffer(ids, "<u4").tolist())
    assert (got["length"] == got["ids"].map(lambda b: len(b) // 4)).all()
    assert got["length"].sum() == sum(len(t) for _, t in want)
    once = [r for r in want if [i for i, _ in want].count(r[0]) == 1]
    for i, ids in once:
        part = got[got["doc_id"].isna() if i < 0 else got["doc_id"] == i].sort_values("start")
        assert sum((tokens(b) for b in part["ids"]), ()) == ids
        assert (part["doc_tokens"] == len(ids)).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 1024


def test_packing_gives_added_tokens_their_ids(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark}x  {mark}\n\n y", "<|endoftext|", f"don't{mark} \n", f"<|{mark}|>", mark.upper(), f"{PROSE[3]} {mark} {PROSE[4]}", f"a{' ' * 30_000}b\n{' \n' * 20_000}"]
    got = packing.pack_documents(documents(spark, texts)).toPandas().sort_values("start")
    for i, t in enumerate(texts):
        part = got[got["doc_id"] == i]
        want = reference.encode(t, add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(part["ids"]), "<u4").tolist() == want
        assert (part["doc_tokens"] == len(want)).all()


def test_packing_pads_little(spark):
    got = packing.pack_documents(documents(spark, [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(5, 900))) for _ in range(300)])).toPandas()
    assert got["length"].sum() / (1024 * got["sequence_id"].nunique()) > 0.97


def test_differencing_balances():
    sizes = [RNG.randint(1, 200) for _ in range(400)]
    window, sums = packing.differencing(sizes, 40)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 8
    assert np.bincount(window, weights=sizes, minlength=40).tolist() == sums.tolist()
    assert packing.pack([5, 5, 5], 5).tolist() in ([0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0])
    assert packing.pack([], 5).tolist() == []


def test_pieces_equal_the_library(mixed):
    import sentencepiece

    table, rows = mixed
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in pieces.encode_documents(table).collect())
    ids = [(-1 if i is None else i, library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows]
    assert got == sorted((i, tuple(x), library.decode(x)) for i, x in ids)


def test_prefix_table_equals_merging():
    codec = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    for _ in range(3000):
        word = "".join(RNG.choice("aeinrst▁éß日\n") for _ in range(RNG.randint(1, 14)))
        for part in codec.split(word):
            assert codec.tokens(part) == codec.merge(part)


def plain_simhash(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text).encode())
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(n, linked):
    label = list(range(n))
    while True:
        new = [min(label[j] for j in range(n) if i == j or linked(i, j)) for i in range(n)]
        if new == label:
            return label
        label = new


def test_simhash_equals_brute_force(spark):
    texts = [*ODD, *PROSE, None, PROSE[5], PROSE[6]]
    for base in (PROSE[5], PROSE[6]):
        for _ in range(6):
            w = base.split(" ")
            w[RNG.randrange(len(w))] = RNG.choice(WORDS)
            texts.append(" ".join(w))
    fps = [plain_simhash(t or "", 3) for t in texts]
    want = classes_of(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = simhash.near_duplicates(documents(spark, texts)).select("doc_id", simhash.hex_digits().alias("h"), "component_id").collect()
    assert sorted((r["doc_id"], r["h"], r["component_id"]) for r in got) == [(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, want))]
    assert len(set(want)) < len(texts) - 8


def test_ball_hashing_misses_no_link(spark):
    base = [RNG.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << i for i in RNG.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 3, 4)})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(rows, len(fps)).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    at = {f: i for i, f in enumerate(fps)}
    joined = {(at[a], at[b]) for a, b in edges} | {(at[b], at[a]) for a, b in edges}
    assert classes_of(len(fps), lambda i, j: (i, j) in joined) == classes_of(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)


def test_components_of_a_long_path(spark):
    order = list(range(200))
    RNG.shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (5, 5), (None, 3), (order[0], order[1])], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 200)}
    assert connected_components(edges.limit(0)).count() == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or pii.luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    for _ in range(20000):
        text = "".join(RNG.choice("0123459 .-+()@ab.@é") for _ in range(RNG.randint(1, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_field_spreads_labels_over_repeats(spark):
    known = [f"call +1 (555) 010-{i:04d} or mail user{i}@site{i % 7}.example.com or 4539578763621486 now" for i in range(60)]
    plain = [f"we saw {i} birds in {1900 + i} and 12 more" for i in range(60)]
    docs = documents(spark, known + plain)
    field = pii.fit(docs)
    table = documents(spark, [*known[:3], *plain[:3], None, ""], [*range(7), None])
    got = {r["doc_id"]: r for r in pii.find_personal_data(table, field).collect()}
    assert [s["kind"] for s in got[0]["base"]] == ["email", "card", "phone"]
    assert all(not got[i]["spans"] for i in (3, 4, 5, 6)) and not got[None]["spans"]
    for r in got.values():
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    # a skip edge moves the belief of an unclear token towards its labelled copy
    weights = np.zeros((pii.FEATURES, 5))
    weights[1, 3] = 4
    skip = np.where(np.eye(5), 2.0, -2.0)
    alone = pii.SkipChainField(weights, np.zeros((5, 5)), skip)
    assert alone.marginals([[1], [2]], [(0, 1, True)])[1].argmax() == 3
    assert abs(alone.marginals([[1], [2]], [])[1].max() - 0.2) < 1e-9


def test_field_finds_what_patterns_miss(spark):
    """Planted mentions without prefix or domain: recall and precision of the added spans, where patterns find none."""
    field = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    hit = wrong = missed = 0
    for i in range(400):
        text, truth = prose(30), set()

        def put(lead, said, kind=None):
            nonlocal text
            text += f" {lead} "
            if kind:
                truth.add((kind, len(text), len(text) + len(said)))
            text += said + " " + prose(rng.randint(5, 40))

        if i % 2:
            a, b, c, name = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999), f"{rng.choice(WORDS)}.long{rng.randint(1, 99)}"
            put("call", f"+1 ({a}) {b}-{c}")
            put("or dial", f"{b}-{c}", "phone")
            put("mail", f"{name}@site{i}.example.com")
            put("write to", f"{name}@site{i}", "email")
            put("order", str(rng.randint(1000000, 9999999)))
        else:
            order = str(rng.randint(1000000, 9999999))
            put("order", order)
            put("again", order)
            put("see", f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}")
            put("from", f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}")
        put("in", str(rng.randint(1900, 2020)))
        base, spans = pii.spans_of(text, field)
        assert not set(base) & truth
        added = set(spans) - set(base)
        hit, wrong, missed = hit + len(added & truth), wrong + len(added - truth), missed + len(truth - added)
    assert hit / (hit + missed) > 0.75 and wrong / (hit + wrong) < 0.02, (hit, wrong, missed)


def test_long_text_without_white_space(spark):
    docs = documents(spark, ["7" * 300_000, "a@" * 50_000, "a1" * 100_000, None, ""])
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, pii.fit(docs)).collect()}
    assert not any(got[i]["spans"] for i in range(5))


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(1)
    field = pii.SkipChainField(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(5, 5)), np.zeros((5, 5)))
    got = field.marginals([[0], [1], [2]], [(0, 1, False), (1, 2, False)], rounds=60)
    w, joint = np.exp(field.weights[:3]), np.exp(field.chain)
    p = w[0][:, None, None] * joint[:, :, None] * w[1][None, :, None] * joint[None] * w[2][None, None]
    want = np.array([p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))]) / p.sum()
    assert np.abs(got - want).max() < 1e-6


def test_redaction_replaces_all_spans():
    assert pii.mask("a b@c.de f", [("email", 2, 8)]) == "a <email> f"
    assert pii.mask("0123456789", [("card", 2, 8), ("phone", 4, 9)]) == "01<card>9"


@pytest.fixture(scope="module")
def labelled(spark):
    bad = ["idiot", "moron", "scum", "trash"]
    rows = []
    for i in range(400):
        words = [RNG.choice(WORDS) for _ in range(RNG.randint(20, 60))]
        if i % 5 == 0:
            words[3:3] = RNG.sample(bad, 2)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), rows


def test_toxicity_finds_held_out_documents(labelled):
    table, rows = labelled
    index = toxicity.fit(toxicity.bounded_sample(table.select("doc_id", "text"), table.select("doc_id", "toxic")))
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i in index.ids.tolist())
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(table, index).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((s >= toxicity.THRESHOLD) == y for s, y in held) and all(0 <= s <= 1 for s, _ in held)


def test_all_significant_terms_of_both_labels_are_kept(spark):
    bad, good = [[f"{c}{w}q{k}" for k, w in enumerate(WORDS[:150])] for c in "xz"]
    rows = [(i, " ".join(bad if i % 4 == 0 else good), int(i % 4 == 0)) for i in range(200)]
    examples = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    corpus = documents(spark, [bad[0], f"{bad[0]} {good[0]}", None, "other", f"{bad[0]} {bad[0]}"])
    index = toxicity.fit(examples, corpus=corpus)
    assert {*bad, *good} <= index.vocabulary.keys()
    idf = lambda t: index.idf[index.vocabulary[t]]
    assert np.allclose([idf(bad[0]), idf(good[0]), idf(bad[1])], np.log(6 / np.array([4, 2, 1])) + 1)


def test_blocks_give_the_exact_neighbours(labelled):
    rng = np.random.default_rng(3)
    vocabulary = {f"t{i}": i for i in range(40)}
    examples = [(i, int(rng.integers(2)), {int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(0, 6), replace=False)}) for i in range(900)]
    index = toxicity.NearestLabelled.build(vocabulary, rng.integers(1, 300, 40).astype(float), 900, examples)
    dense = np.zeros((len(index.ids), 40))
    by_id = {i: c for i, _, c in examples}
    for row, i in enumerate(index.ids.tolist()):
        terms, w = index._weights(by_id[i], index.idf)
        dense[row, terms] = w
    for _ in range(50):
        counts = {int(t): int(rng.integers(1, 4)) for t in rng.choice(40, 5, replace=False)}
        terms, w = index._weights(counts, index.idf)
        want = np.sort(dense[:, terms] @ w)[::-1][: toxicity.NEIGHBOURS]
        assert np.abs(index.nearest(counts)[1] - want).max() < 1e-9


def test_scores_equal_a_plain_vote_over_all_examples(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(toxicity.bounded_sample(docs, labels), corpus=docs)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    def plain(text):
        words = re.findall(r"[^\W_]+", text.lower())
        vector = np.zeros(len(index.vocabulary))
        for t, k in index.vocabulary.items():
            n = sum(w.startswith(t[:-1]) and len(w) >= len(t) for w in words) if t.endswith("*") else words.count(t)
            vector[k] = (1 + np.log(n)) * index.idf[k] if n else 0
        length = np.sqrt(vector @ vector)
        return vector / length if length else vector

    vectors = {i: plain(t) for i, t in texts.items()}
    for k, t in enumerate(index.vocabulary):
        seen = sum(v[index.vocabulary[t]] > 0 for v in vectors.values())
        assert abs(index.idf[k] - (np.log((1 + len(texts)) / (1 + seen)) + 1)) < 1e-9
    examples = np.array([vectors[i] for i in index.ids.tolist()])
    assert len(examples) > 20
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, index).collect()}
    assert got.keys() == texts.keys()
    for i, v in vectors.items():
        cosines = (examples @ v).round(12)
        best = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.NEIGHBOURS]
        best = best[cosines[best] > 0]
        votes = cosines[best] ** 2
        raw = (votes @ index.labels[best] + toxicity.PRIOR_WEIGHT * index.base) / (votes.sum() + toxicity.PRIOR_WEIGHT)
        odds = np.exp(index.curve[0] * np.log(raw / (1 - raw) if raw > 1e-4 else 1e-4 / (1 - 1e-4)) + index.curve[1])
        assert abs(got[i]["score"] - odds / (1 + odds)) < 1e-6
        assert [e["id"] for e in got[i]["evidence"]] == index.ids[best].tolist()
    outside = {i for i in texts if zlib.crc32(str(i).encode()) % 8 == 3}
    assert outside and not outside & {*index.ids.tolist()}


def test_calibration_follows_the_observed_rate():
    rng = np.random.default_rng(5)
    raw = rng.uniform(0, 1, 20_000)
    labels = (rng.uniform(0, 1, 20_000) < raw**2).astype(int)
    slope, intercept = toxicity.logistic_map(raw, labels)
    p = 1 / (1 + np.exp(-(slope * toxicity._logit(raw) + intercept)))
    assert slope > 0 and abs(p.mean() - labels.mean()) < 0.01
    for low, high in ((0.1, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9)):
        part = (p >= low) & (p < high)
        assert abs(p[part].mean() - labels[part].mean()) < 0.06
    assert toxicity.logistic_map(raw, np.zeros(20_000, int)) == (1.0, 0.0)


def test_toxicity_of_odd_tables(spark, labelled):
    table, _ = labelled
    index = toxicity.fit(table)
    got = toxicity.score_documents(documents(spark, [None, "", "idiot moron"], [None, 1, 1]), index).collect()
    assert sorted((r["doc_id"] or -1, r["score"] >= 0.3) for r in got) == [(-1, False), (1, False), (1, True)]
    assert toxicity.score_documents(documents(spark, ["x"]).limit(0), index).count() == 0
    none = toxicity.fit(table.limit(0))
    assert 0 <= toxicity.score_documents(documents(spark, ["x"]), none).first()["score"] < 0.3


def plain_repeats(rows, least):
    out = []
    for i, text in rows:
        gone = [False] * len(text)
        for p in range(len(text) - least + 1):
            w = text[p : p + least]
            if any(j is not None and (i is None or j < i) and w in other for j, other in rows):
                gone[p : p + least] = [True] * least
        out.append((i, bytes(b for b, g in zip(text, gone) if not g), sum(g and not h for g, h in zip(gone, [False, *gone]))))
    return out


@pytest.mark.parametrize("alphabet,least", [("ab", 50), ("abcdefghij é", 50), ("etaoin shrdlu", 24)])
def test_repeats_equal_brute_force(spark, alphabet, least):
    parts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(1, 90))) for _ in range(12)] + ["a" * 120, "ab" * 60]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 5))) for _ in range(40)] + [None, "", parts[0]]
    ids = [*range(len(texts) - 2), 3, None]
    want = plain_repeats([(i, (t or "").encode()) for i, t in zip(ids, texts)], least)
    got = substrings.remove_repeats(documents(spark, texts, ids), least=least).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["kept"], len(r["spans"])) for r in got), key=key) == sorted(((i, k, n) for i, k, n in want), key=key)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"]) for r in got)


CLUSTER = """
import hashlib, sys
from pyspark.sql import SparkSession
import corpus_pipeline
from tessella.llm import substrings
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "768m").config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").config("spark.ui.showConsoleProgress", "false")
    .config("spark.checkpoint.dir", sys.argv[1] + "/shared").config("spark.executorEnv.PYTHONPATH", sys.argv[2]).getOrCreate())
docs = spark.read.parquet(sys.argv[1] + "/docs")
for r in substrings.remove_repeats(docs).collect():
    print("row", r["doc_id"], hashlib.sha256(r["kept"]).hexdigest(), len(r["spans"]))
for r in corpus_pipeline.drop_repeated_passages(spark, docs, None).collect():
    print("stage", r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest(), r["n_chars"])
spark.stop()
"""


def test_repeats_on_several_executors(spark, sf_dir, tmp_path):
    """The operator and the pipeline's stage, beside this session: a JVM of its own, with its own small memory and address."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(8).write.parquet(f"{tmp_path}/docs")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    smallest = {}
    for i in sorted(texts):
        for at in range(len(texts[i]) - 49):
            smallest.setdefault(texts[i][at : at + 50], i)
    want = set()
    for i, t in texts.items():
        gone = bytearray(len(t))
        for at in range(len(t) - 49):
            if smallest[t[at : at + 50]] < i:
                gone[at : at + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.add(f"row {i} {hashlib.sha256(kept).hexdigest()} {bytes(gone).replace(bytes(1), b' ').split().__len__()}")
        left = kept.decode("utf-8", "ignore")
        want.add(f"stage {i} {hashlib.sha256(left.encode()).hexdigest()} {len(left)}")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_LOCAL_IP": "127.0.0.1", "TMPDIR": str(tmp_path)}
    with open(f"{tmp_path}/out", "w") as out, open(f"{tmp_path}/err", "w") as err:
        done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), os.environ["PYTHONPATH"]], stdout=out, stderr=err, env=env, timeout=400)
    with open(f"{tmp_path}/err") as err:
        assert done.returncode == 0, err.read()  # whole, as the JVM's own words come first
    with open(f"{tmp_path}/out") as out:
        assert {x.rstrip("\n") for x in out if x.startswith(("row ", "stage "))} == want
    assert any(x.startswith("row") and not x.endswith(" 0") for x in want)


def test_group_order_does_not_depend_on_arrival():
    rows = [(3, "b"), (None, "z"), (3, "a"), (1, "ö"), (None, "a"), (3, "a")]
    for _ in range(20):
        RNG.shuffle(rows)
        table, ids, texts = substrings.in_order(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}))
        assert texts == [t.encode() for t in table.column("text").to_pylist()] == ["ö".encode(), b"a", b"a", b"b", b"a", b"z"]
        assert table.column("doc_id").to_pylist() == [1, 3, 3, 3, None, None] and ids[0] == 1


def test_bounded_sorting_equals_sorting_at_once():
    parts = ["".join(RNG.choice("ab c") for _ in range(RNG.randint(20, 60))) for _ in range(6)] + ["a" * 70]
    for chunk in (1, 200, 100_000):
        strings = list({"".join(RNG.choice(parts) for _ in range(4))[: RNG.randint(50, 200)].encode().ljust(50, b".") for _ in range(60)})
        ids = np.array([RNG.randint(1, 99) for _ in strings], np.int64)
        want = substrings.smallest_ids(strings, ids)
        got = substrings.bounded_smallest_ids(strings, ids, np.zeros(len(strings), np.uint64), chunk=chunk)
        assert all((a == b).all() for a, b in zip(want, got))


def test_interval_expansion_classes():
    for _ in range(200):
        least, letters = RNG.choice([3, 5, 9, 17]), RNG.choice([b"ab", b"\0a", b"abcdefgh"])
        strings = list({bytes(RNG.choice(letters) for _ in range(least + RNG.randint(0, 20))) for _ in range(RNG.randint(1, 12))})
        want, got = {}, {}
        for i, s in enumerate(strings):
            for o in range(len(s) - least + 1):
                want.setdefault(s[o : o + least], []).append((i, o))
        for i, o, g in zip(*(x.tolist() for x in substrings.shared_prefixes(strings, least))):
            got.setdefault(g, []).append((i, o))
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_long_texts_are_cut_without_losing_windows(monkeypatch, spark):
    monkeypatch.setattr(substrings, "BUFFER", 100)
    texts = [b"".join(bytes([RNG.randrange(97, 110)]) for _ in range(n)) for n in (0, 49, 50, 51, 99, 149, 150, 640)]
    seen = [(d, s) for _, _, doc, start in substrings._buffers(texts, 50) for d, s in zip(doc.tolist(), start.tolist())]
    assert sorted(seen) == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 49)]
    for data, place, doc, start in substrings._buffers(texts, 50):
        assert all(data[p : p + 50].tobytes() == texts[d][s : s + 50] for p, d, s in zip(place.tolist(), doc.tolist(), start.tolist()))


@pytest.mark.parametrize("run", [packing.pack_documents, pieces.encode_documents, simhash.near_duplicates, substrings.remove_repeats, lambda d: pii.find_personal_data(d, pii.fit(d))])
def test_empty_tables_give_empty_results(spark, run):
    assert run(documents(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_pack", "op3_simhash", "op4_pii", "op5_toxicity", "op6_pieces", "op7_repeats"])
def test_queries_cover_every_document(spark, sf_dir, name):
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    got = queries.QUERIES[name](spark, sf_dir).select("doc_id").distinct().collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)


def test_query_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    base = {r["doc_id"]: ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(r["text"])) for r in rows}
    got = queries.op4_pii(spark, sf_dir).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == {i: hashlib.sha256(b.encode()).hexdigest() for i, b in base.items()}
    for kind in pii.KINDS:
        assert all(r[f"n_{kind}"] == base[r["doc_id"]].count(f"{kind}:") for r in got)
    assert len(got) == len(rows) and all(set(filter(None, base[r["doc_id"]].split(","))) <= set(r["spans"].split(",")) for r in got)
