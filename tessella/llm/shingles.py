"""Near copies by the Jaccard similarity of word shingles: SimHash balls and MinHash bands, exact verification.

Each distinct text is the set of its five-word shingles. Its SimHash over them is a 64-bit fingerprint, and
fingerprints within 3 bits meet by ball hashing (see ``simhash``). Similarity 0.8 lies near 10 differing bits,
far beyond what balls can reach, so texts whose MinHash values agree in one of 24 bands of 5 meet as well; at
similarity 0.8 a pair misses all bands with probability (1 - 0.8**5)**24 < 1e-4. First every bucket's members
are held against its least and its most central member only, which is linear in the bucket and joins dense groups.
Then, only in buckets that still hold several components, members outside the largest one meet all others in
blocks, so no pair that shares a bucket is left undecided and no list of pairs is made. Every link, of balls and of bands, is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, fresh_path, id_and_text, trim_memory, write_and_forget
from tessella.llm.components import connected_components
from tessella.llm.simhash import links

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SEED = 42
BLOCK_TOKENS = 1_000_000  # shingles that a task holds of one side of a large bucket
PAIRS_A_COPY = 256  # a text in many pairs is sent to several tasks
SEEN = 1_000_000
_RNG = np.random.default_rng(20260914)
_MIX = _RNG.integers(0, 1 << 64, (2, WORDS), np.uint64) | np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str, words_each: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.array([digest(w, SEED) for w in words], np.uint64)
    n = len(one) - words_each + 1
    total = np.zeros(n, np.uint64)
    for k in range(words_each):
        x = one[k : k + n] * _MIX[0, k]
        total += (x ^ (x >> np.uint64(29))) * _MIX[1, k]
    return np.unique(total ^ (total >> np.uint64(32)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band, as signed longs; texts without words share theirs."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[i : i + 512, None] ^ _FLIP) * _TIMES).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def majority(hashes: np.ndarray) -> int:
    """SimHash as a signed long: each bit that is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        keys, nodes, prints = [], [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node not in seen:
                seen.add(node)
                found = shingles(text)
                keys += [*band_keys(found), majority(found)]
                nodes += [node] * (BANDS + 1)
                prints += [False] * BANDS + [True]
        if len(seen) > SEEN:
            seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prints, pa.bool_())], ["key", "node", "is_print"])
    trim_memory()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])
    trim_memory()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of at least that similarity; ``a`` may be in very many pairs."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("parts"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    hold = sets.withColumnRenamed("node", "a").join(degree, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("sa"))
    both = dealt.join(hold, ["a", "part"]).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    size = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return size.where(F.col("n") >= similarity * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _ball_pairs(prints: DataFrame) -> DataFrame:
    """Candidates ``(a, b)``: texts of one fingerprint with the least of them, and the least of fingerprints within 3 bits."""
    least = checkpoint(prints.groupBy("fp").agg(F.min("node").alias("node")))
    same = prints.join(least.withColumnRenamed("node", "a"), "fp").select("a", F.col("node").alias("b"))
    near = links(least.select("fp"), least.count()).toDF("fa", "fb")
    near = near.join(least.toDF("fa", "a"), "fa").join(least.toDF("fb", "b"), "fb").select("a", "b")
    return same.where("a <> b").unionByName(near)


def _nodes(met: DataFrame, balls: DataFrame) -> DataFrame:
    return met.select("node").unionByName(balls.select(F.explode(F.array("a", "b")).alias("node"))).distinct()


def _to_hubs(met: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, least first, of each bucket's members with its hub and with its least member.

    The hub is the member in the largest buckets over all bands: of many variants of one text it is the most central.
    """
    ends = met.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"), F.min("node").alias("lo"))
    other = met.join(ends, "key").select("node", F.explode(F.array("hub", "lo")).alias("o")).where("node <> o")
    return other.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))


def _open(met: DataFrame, label: DataFrame) -> DataFrame:
    """``key, node, class, major``: members of buckets that still hold several components, and the bucket's largest one."""
    named = met.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("class"))
    sizes = named.groupBy("key", "class").agg(F.count("*").alias("n"))
    majors = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("major"), F.count("*").alias("classes"))
    return named.join(majors.where("classes > 1").select("key", "major"), "key")


def _across(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that join different components of one bucket, each pair of such members verified.

    Members outside the bucket's largest component meet all its members. Both sides are split into blocks of bounded
    size; a task returns a spanning forest of the links it finds, never its pairs.
    """
    rows = open_.join(sets, "node").withColumn("asks", F.col("class") != F.col("major"))
    tokens = F.size("shingles").cast("long") + 1
    blocks = lambda total: F.greatest(F.lit(1), F.ceil(total / BLOCK_TOKENS)).cast("int")
    parts = rows.groupBy("key").agg(blocks(F.sum(tokens)).alias("held"), blocks(F.sum(F.when(F.col("asks"), tokens))).alias("asked"))
    dealt = rows.join(parts, "key")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("asks").select("key", mine("asked").alias("a"), every("held").alias("h"), "node", "class", "shingles")
    right = dealt.select(F.col("key").alias("key"), every("asked").alias("a"), mine("held").alias("h"), F.col("node").alias("node"), F.col("class").alias("class"), F.col("shingles").alias("shingles"))

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if ask.num_rows and have.num_rows:
            nodes, classes = (have.column(c).to_numpy() for c in ("node", "class"))
            lists = have.column("shingles").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            known, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            holder = np.repeat(np.arange(len(nodes)), size)[np.argsort(at, kind="stable")]  # members by shingle
            start = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(known)))))
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for node, kind, mine_ in zip(ask.column("node").to_pylist(), ask.column("class").to_pylist(), ask.column("shingles")):
                own = mine_.values.to_numpy()
                spot = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                spot = spot[known[spot] == own] if len(known) else spot[:0]
                count = start[spot + 1] - start[spot]
                shared = np.bincount(holder[np.repeat(start[spot] - np.cumsum(count) + count, count) + np.arange(count.sum())], minlength=len(nodes))
                for k in np.flatnonzero((shared >= similarity * (len(own) + size - shared)) & (classes != kind)).tolist():
                    x, y = find(kind), find(int(classes[k]))
                    if x != y:
                        root[x] = y
                        out.append((node, int(nodes[k])))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return left.groupBy("key", "h", "a").cogroup(right.groupBy("key", "h", "a")).applyInArrow(meet, "a long, b long")


def node_of(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, node, class, component_id)``: one row per document with the smallest id reachable by links.

    ``node`` is the hash of the text, ``class`` the least node of its component. Texts are read whole, case aside; null texts and those without words
    are alike; repeated rows come out once each; a null id is kept and never names a component unless
    all ids of it are null; an empty table gives an empty one. Other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("node", node_of("text"))
    keep = lambda df: write_and_forget(df, fresh_path(docs.sparkSession, "near"))
    emitted = keep(rows.select("node", "text").mapInArrow(_emit, "key long, node long, is_print boolean"))
    balls = keep(_ball_pairs(emitted.where("is_print").select(F.col("key").alias("fp"), "node").distinct()))
    bands = emitted.where("NOT is_print").select("key", "node").distinct()
    size = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = keep(bands.join(size, "key"))
    weight = met.groupBy("node").agg(F.sum("size").alias("weight"))
    met = keep(met.join(weight, "node").select("key", "node", "weight"))
    sets = keep(rows.select("node", "text").dropDuplicates(["node"]).join(_nodes(met, balls), "node", "left_semi").mapInArrow(_sets, "node long, shingles array<long>"))
    tried = keep(_to_hubs(met).unionByName(balls).distinct())
    linked = keep(_verified(tried, sets, similarity))
    more = keep(_across(_open(met, connected_components(linked)), sets, similarity))
    joined = connected_components(linked.unionByName(more))
    ids = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = ids.join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    heads = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(classes.join(heads, "class").select("node", "class", "component_id"), "node").select("doc_id", "node", "class", "component_id")
