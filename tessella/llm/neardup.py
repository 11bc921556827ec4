"""Embedding near-duplicates by rotated binary codes with stored correction factors.

Equal vectors are collapsed first. Each distinct unit vector is rotated at random and kept as the
signs of its coordinates with the factor o = <signs / sqrt(D), rotated vector>. For another vector y,
<signs / sqrt(D), rotated y> / o estimates <x, y> without bias, with an error below
e * sqrt((1 - o**2) / o**2) / sqrt(D - 1) at confidence level e; only pairs whose upper bound reaches
the threshold are computed exactly. Vectors meet in cells around random directions: each goes to its
few nearest cells, large cells are split into pairs of blocks, and a pair counts in the smallest cell
that both share, so links are counted without being shuffled and no pair list is built. The number of
cells follows the number of vectors without a bound: beyond ``SINGLE`` of them a cell is a pair of
directions, one from each of two sets of about the square root of that number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint
from tessella.llm.components import connected_components
from tessella.llm.vectors import matrix, prepared

THRESHOLD = 0.9
SINGLE = 4096
PROBES, PAIR_PROBES = 8, 24  # cells of a vector, with one set of directions and with two
CELL_ROWS = 256
BLOCK_ROWS = 4096
LEVEL = 3.5
SEED = 20240131


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def directions(dim: int, n: int, which: int = 0) -> np.ndarray:
    d = np.random.default_rng([SEED, dim, n, *[which] * (which > 0)]).standard_normal((n, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def cell_sets(n_vectors: int) -> list[int]:
    """Sizes of the one or two sets of directions that make about a cell per ``CELL_ROWS`` vectors."""
    cells = max(16, n_vectors // CELL_ROWS)
    return [cells] if cells <= SINGLE else [math.isqrt(cells - 1) + 1] * 2


def home_cells(rotated: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The nearest cells of each vector, ascending; of two sets, the pairs of largest summed inner product."""
    if len(sets) == 1:
        take = min(PROBES, len(sets[0]))
        return np.sort(np.argpartition(-(rotated @ sets[0].T), take - 1, axis=1)[:, :take], axis=1).astype(np.int32)
    out = []
    for part in np.array_split(rotated, -(-len(rotated) // 1024)):
        near = [part @ s.T for s in sets]
        best = [np.argpartition(-x, min(PAIR_PROBES, x.shape[1]) - 1, axis=1)[:, :PAIR_PROBES] for x in near]
        one, two = (np.take_along_axis(x, b, 1) for x, b in zip(near, best))
        sums = (one[:, :, None] + two[:, None, :]).reshape(len(part), -1)
        top = np.argpartition(-sums, PAIR_PROBES - 1, axis=1)[:, :PAIR_PROBES]
        width = two.shape[1]
        out.append(np.take_along_axis(best[0], top // width, 1) * len(sets[1]) + np.take_along_axis(best[1], top % width, 1))
    return np.sort(np.concatenate(out), axis=1).astype(np.int32)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (0 or 1) and correction factors of rotated unit vectors."""
    return (rotated >= 0).astype(np.uint8), np.abs(rotated).sum(axis=1) / np.sqrt(rotated.shape[1])


def candidate_pairs(signs: np.ndarray, factor: np.ndarray, other: np.ndarray, threshold: float, level: float = LEVEL) -> np.ndarray:
    """Pairs (row, other row) whose inner product may reach ``threshold`` by the codes of the first side."""
    dim = signs.shape[1]
    estimate = ((signs.astype(np.float32) * 2 - 1) @ other.T.astype(np.float32)) / (np.sqrt(dim) * factor[:, None].astype(np.float32))
    error = level * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2) / np.sqrt(max(1, dim - 1))
    return np.argwhere(estimate + error[:, None] >= threshold)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
    of different length never link. Repeated and equal rows link with each other; rows of one id with
    different vectors have links of their own. A null id is kept with its links, and a component without
    any other id has none. An empty table gives an empty one. Other columns are not read.
    """
    rows = prepared(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    distinct = checkpoint(rows.groupBy("v").agg(F.min("vec_id").alias("head"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))  # kept by the checkpoint
    sets = cell_sets(distinct.count())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, toward = {}, {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                if dim not in turn:
                    turn[dim], toward[dim] = rotation(dim), [directions(dim, k, i) for i, k in enumerate(sets)]
                rotated = unit(matrix(part.column(0))) @ turn[dim].T
                signs, factor = codes(rotated)
                home = home_cells(rotated, toward[dim])
                packed = np.packbits(signs, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(part), pa.int32()), part.column(1), part.column(2), part.column(0), pa.array(list(map(bytes, packed)), pa.binary()), pa.array(factor), pa.array(list(home), pa.list_(pa.int32()))],
                    ["dim", "node", "copies", "v", "code", "factor", "cells"],
                )

    placed = distinct.select("v", "node", "copies").mapInArrow(assign, "dim int, node long, copies long, v array<double>, code binary, factor double, cells array<int>")
    dealt = placed.withColumn("cell", F.explode("cells"))
    sizes = dealt.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    large = sizes.where("blocks > 1")  # a small table, as only cells over a block are in it
    split = dealt.join(large, ["dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = split.select("dim", "cell", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "copies", "v", "code", "factor", "cells")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        dim, cell, low, high = (k.as_py() for k in key)
        v, node, copies = unit(matrix(group.column("v"))), group.column("node").to_numpy(), group.column("copies").to_numpy()
        rotated, factor, lists = v @ rotation(dim).T, group.column("factor").to_numpy(), matrix(group.column("cells"))
        signs = np.unpackbits(np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(node), -1), axis=1)[:, :dim]
        mine = group.column("mine").to_numpy()
        one, two = np.flatnonzero(mine == low), np.flatnonzero(mine == high)
        links, a_all, b_all = np.zeros(len(node), np.int64), [], []
        for i in range(0, len(one), 1024):
            for j in range(0, len(two), 1024):
                x, y = one[i : i + 1024], two[j : j + 1024]
                pairs = candidate_pairs(signs[x], factor[x], rotated[y], threshold)
                a, b = x[pairs[:, 0]], y[pairs[:, 1]]
                if low == high:
                    a, b = a[a < b], b[a < b]  # each pair once
                exact = np.concatenate([(v[a[s : s + 65536]] * v[b[s : s + 65536]]).sum(axis=1) for s in range(0, len(a), 65536)] or [np.empty(0)])
                a, b = a[exact >= threshold], b[exact >= threshold]
                if len(a):
                    first = np.array([np.where((lists[a[s : s + 65536], :, None] == lists[b[s : s + 65536], None, :]).any(axis=2), lists[a[s : s + 65536]], 1 << 30).min(axis=1) for s in range(0, len(a), 65536)], dtype=object)
                    here = np.concatenate(list(first)) == cell
                    np.add.at(links, a[here], copies[b[here]])
                    np.add.at(links, b[here], copies[a[here]])
                    a_all.append(a)
                    b_all.append(b)
        label = _labels(len(node), np.concatenate(a_all), np.concatenate(b_all)) if a_all else np.arange(len(node))
        out = np.flatnonzero((links > 0) | (label != np.arange(len(node))))
        return pa.table({"node": node[out], "links": links[out], "toward": node[label[out]]})

    found = checkpoint(keyed.groupBy("dim", "cell", "low", "high").applyInArrow(compare, "node long, links long, toward long"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("node <> toward"), "node", "toward").select("node", "component")
    classes = distinct.join(counted, "node", "left").join(joined, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = classes.groupBy("class").agg(F.min("head").alias("component_id"))
    named = classes.join(smallest, "class").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    all_rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    out = all_rows.join(named, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
