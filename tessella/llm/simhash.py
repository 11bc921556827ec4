"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within Hamming radius r share a midpoint within half the radius of both. For the
odd radius 3 half a bit is left over: the 64 bits are cut into four blocks, and one block at a time
is masked. If two fingerprints differ in 3 bits, at least one block holds a differing bit, so with
that block masked they differ in 2 at most and their balls of radius 1 meet. Each *distinct*
fingerprint hence emits 4 x (1 + 48) variants; the variants are shuffled, and the fingerprints that
meet are verified against each other. A bucket is bounded by 49 * 2**16 fingerprints whatever the
number of rows, and yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, id_and_text, parts_for, trim_memory
from tessella.llm.components import connected_components

SEED = 42
BLOCKS = 4
ROWS_A_PART = 1_000_000


def fingerprint(text: str, words_each: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < words_each:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: n - words_each + 1].tolist()
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[words_each - 1 :] - 1).tolist())]
    counts, total = np.zeros(64, np.int64), len(hashes)
    for i in range(0, total, 65536):
        bits = np.array(hashes[i : i + 65536], np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > total).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` holds the 64 bits as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words_each) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        trim_memory()

    return id_and_text(docs, id_col, text_col).mapInArrow(compute, "doc_id long, fp long")


def _variants(blocks: int = BLOCKS):
    """Column expression: all variants of ``fp`` within half the radius, one block masked in turn."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    width, out = 64 // blocks, []
    for b in range(blocks):
        block = ((1 << width) - 1) << (b * width)
        mark = (0xA5C3 ^ b) << (b * width) & block  # tells the masked blocks apart
        flips = [0] + [1 << i for i in range(64) if not block >> i & 1]
        kept = F.col("fp").bitwiseAND(F.lit(signed(~block & (1 << 64) - 1)))
        out += [kept.bitwiseXOR(F.lit(signed(f | mark))) for f in flips]
    return F.array(*out)


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over distinct fingerprints at ``radius`` or fewer differing bits."""
    left = fps
    while len(left):
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            near = np.bitwise_count(left ^ edge[0]) <= radius
            yield from ((edge[0], x) for x in left[near])
            edge, left = np.concatenate((edge[1:], left[near])), left[~near]


def links(distinct: DataFrame, n_rows: int, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """Verified links ``(a, b)`` that connect all fingerprints within ``radius`` (3 at most)."""
    assert radius <= 3, "balls of radius 1 with one masked block reach 3 bits"
    spread = distinct.repartition(parts_for(n_rows, 20_000, 8), "fp")
    emitted = spread.select("fp", F.explode(_variants(blocks)).alias("variant"))
    dealt = emitted.repartition(parts_for(n_rows * (64 + blocks), ROWS_A_PART, 8), "variant")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, keys = [], []
        for batch in batches:
            fps.append(batch.column(0).to_numpy())
            keys.append(batch.column(1).to_numpy())
        if not fps:
            return
        fp, key = np.concatenate(fps), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        fp, key = fp[order].view(np.uint64), key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        found: set[tuple[int, int]] = set()
        two = first[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        found.update(zip(fp[near].tolist(), fp[near + 1].tolist()))
        for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            found.update((int(a), int(b)) for a, b in _forest(fp[s : s + n], radius))
        pairs = np.array(sorted({(min(p), max(p)) for p in found}), np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return dealt.mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per document with the smallest id reachable by links.

    Null or empty texts have fingerprint 0 and link like any other; repeated rows come out once
    each; a null id is kept and never names a component unless all ids of it are null; an empty
    table gives an empty one. Other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, words_each))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    n = distinct.count()
    joined = connected_components(links(distinct.select("fp"), n, radius))
    classes = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    heads = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(heads, "class").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(col: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
