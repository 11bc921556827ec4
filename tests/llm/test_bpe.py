"""Byte-level BPE against the library, and the automaton against merging."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest

from tessella.llm import bpe, queries

RNG = random.Random(13)
PATH = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"
ALPHABETS = ["abcdef ", "ab", "\n \t", "日本語テスト😀", "éßñ'sT", "0123456789²½Ⅷ", "a̐éö̲", "​　 \xa0x\x85\x1c", "don't we'LL ", "\x00\x01\x7fz", "".join(map(chr, (0x558, 0x88F, 0x1C89, 0xA7CB, 0x10D40, 0x11DE0, 0x323B0, 0x3D000)))]
SCHEMA = "doc_id long, text string, ids string, decoded string, n_tokens long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts_equal_the_library(library, codec):
    for k in range(8000):
        letters = RNG.choice(ALPHABETS) + RNG.choice(ALPHABETS)
        text = "".join(RNG.choice(letters) for _ in range(RNG.randint(0, 60)))
        text = text + MARK + text if k % 9 == 0 else text
        assert ids_of(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(codec.encode(text)) == text


def test_long_texts_equal_the_library(library, codec):
    noise = "".join(chr(RNG.randint(33, 126)) for _ in range(20_000))
    for text in [" " * 30_000, "x" * 30_000 + " y", "\n" * 9_000 + "ab" * 9_000, noise, f"a{MARK}{MARK} {noise}<|endoftext|", " ".join(noise[i : i + 7] for i in range(0, 20_000, 7)) * 5]:
        assert ids_of(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_every_kind_of_character_splits_as_in_the_library(library, codec):
    split = library.pre_tokenizer.pre_tokenize_str
    probes = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and RNG.random() < 0.05] + sorted(codec.newer)[::50]
    for c in probes:
        text = f"a{c}1{c}!{c} {c}{c}"
        words = codec.words(text) if codec.newer.isdisjoint(text) else codec.older_words(text)
        assert [len(w.encode()) for w in words] == [len(p) for p, _ in split(text)]


def test_bounded_tables_change_nothing(monkeypatch, codec):
    monkeypatch.setattr(bpe, "MAX_ARCS", 40)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 20)
    small = bpe.BpeCodec(PATH)
    for _ in range(500):
        text = "".join(RNG.choice("etaoinshr dlu\n") for _ in range(RNG.randint(1, 200)))
        assert small.encode(text) == codec.encode(text)


def merged(word, merges):
    tokens = list(word)
    for u, v in merges:
        i = 0
        while i < len(tokens) - 1:
            if (tokens[i], tokens[i + 1]) == (u, v):
                tokens[i : i + 2] = [u + v]
            i += 1
    return tokens


def test_automaton_accepts_what_merging_makes():
    """Small vocabularies: every sequence of tokens is accepted if and only if merging its text gives it."""
    for _ in range(150):
        tokens, merges = ["a", "b", "c"][: RNG.randint(1, 3)], []
        for _ in range(RNG.randint(0, 7)):
            u, v = RNG.choice(tokens), RNG.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        number = {t: i for i, t in enumerate(tokens)}
        auto = bpe.TokenAutomaton({i: t.encode() for t, i in number.items()}, [(number[u], number[v], number[u + v]) for u, v in merges])
        for n in range(1, 4):
            for seq in itertools.product(tokens, repeat=n):
                state = 0
                for t in seq:
                    state = auto.arc(state, number[t]) if state >= 0 else -1
                assert (state >= 0) == (merged("".join(seq), merges) == list(seq))


def test_improper_merges_are_refused():
    with pytest.raises(ValueError):
        bpe.TokenAutomaton({0: b"a", 1: b"aa", 2: b"aaa"}, [(1, 0, 2), (0, 0, 1)])


def test_documents(spark, library):
    texts = [None, "", " ", MARK, "a b", "a b", "日本 語" * 50, "x" * 200_000, "é" * 3]
    ids = [None, 0, 1, 2, 3, 3, 4, 5, None]
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in zip(ids, texts)], SCHEMA).repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], ids_of(r["ids"]), r["decoded"]) for r in bpe.encode_documents(table).collect())
    assert got == sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in zip(ids, texts))
    assert bpe.encode_documents(table.limit(0)).count() == 0


def test_query_equals_the_library(spark, sf_dir, library):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_bpe"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys() and re.fullmatch("[0-9a-f]{64}", got[0]["ids_sha256"])
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
