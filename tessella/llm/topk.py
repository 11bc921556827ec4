"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt into blocks by the signs of a few random projections, so that a block holds rows of like
direction; a block with too many rows is split by a hash. Each query first searches the block it lies in,
which bounds its k-th score from below. Of all other blocks only centre and radius are looked at: no inner
product in a block exceeds <q, centre> + radius |q|, and the query is sent to the blocks that may still
reach its k-th score. Rows move to a block once, and once more per ``GROUP_QUERIES`` queries sent to it.

A task builds a cover tree over its queries and one over its block: a node is a centre with a covering
radius, its children cover it at a smaller radius. For a query node and a data node no inner product exceeds
<q, x> + r_q |x| + r_x |q| + r_q r_x (of the centres); pairs are visited by falling bound and dropped
once it is below the worst k-th score in the query group. The k best of each block are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, parts_for
from tessella.llm.vectors import matrix, prepared

SCALE = 1024
BLOCK_ROWS = 16_384
GROUP_QUERIES = 8_192
CHUNK_BLOCKS = 4_096  # blocks whose centres a task holds
SEED = 20240607
LEAF = 64
SHRINK = 0.7
FANOUT = 32
NONE = -(1 << 62)  # below any score


@dataclass
class Node:
    centre: int
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree of all rows: centres of children lie apart, and each child covers its rows.

    Children are chosen farthest first until the rows are covered at ``SHRINK`` of the radius, or the
    fan-out is reached; then every child keeps the radius that its rows need, so bounds stay right.
    """

    def build(rows: np.ndarray, centre: int, away: np.ndarray) -> Node:
        node = Node(centre, float(away.max(initial=0.0)), rows)
        if len(rows) <= leaf or not node.radius:
            return node
        centres, nearest, owner = [centre], away.copy(), np.zeros(len(rows), np.int64)
        while nearest.max() > SHRINK * node.radius and len(centres) < FANOUT:
            far = int(nearest.argmax())
            d = np.sqrt(((points[rows] - points[rows[far]]) ** 2).sum(axis=1))
            closer = d < nearest
            owner[closer], nearest = len(centres), np.minimum(d, nearest)
            centres.append(int(rows[far]))
        node.children = [build(rows[owner == c], x, nearest[owner == c]) for c, x in enumerate(centres)] if len(centres) > 1 else []
        return node

    rows = np.arange(len(points))
    return build(rows, 0, np.sqrt(((points - points[0]) ** 2).sum(axis=1)))


def dual_tree(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's ``k`` best rows with another id; ties to the smaller id. -1 pads.

    Rows below a query's ``floor`` may be left out.
    """
    exact = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(data).max(initial=0))) * queries.shape[1] < 1 << 53
    q, x = queries.astype(float), data.astype(float)
    low = NONE
    floor = np.full(len(q), low) if floor is None else floor
    scores, ids = np.full((len(q), k), low), np.full((len(q), k), -1, np.int64)
    if not len(q) or not len(x):
        return scores, ids
    nq, nx = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
    slack = 1e-9 * (1 + nq.max() * nx.max())

    def bound(a: Node, b: Node) -> float:
        return float(q[a.centre] @ x[b.centre]) + a.radius * nx[b.centre] + b.radius * nq[a.centre] + a.radius * b.radius + slack

    def worst(a: Node) -> float:
        return np.maximum(scores[a.rows, -1], floor[a.rows]).min()

    def compare(a: Node, b: Node) -> None:
        s = (q[a.rows] @ x[b.rows].T).astype(np.int64) if exact else queries[a.rows] @ data[b.rows].T
        s[query_ids[a.rows][:, None] == data_ids[b.rows][None, :]] = low
        all_s = np.concatenate((scores[a.rows], s), axis=1)
        all_i = np.concatenate((ids[a.rows], np.broadcast_to(data_ids[b.rows], s.shape)), axis=1)
        order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
        scores[a.rows], ids[a.rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
        ids[a.rows] = np.where(scores[a.rows] == low, -1, ids[a.rows])

    left, right = cover_tree(q), cover_tree(x)
    stamp, heap = 0, [(-bound(left, right), 0, left, right)]
    while heap:
        high, _, a, b = heapq.heappop(heap)
        if -high < worst(a):
            continue
        if not a.children and not b.children:
            compare(a, b)
            continue
        halve_a = bool(a.children) and (not b.children or a.radius > b.radius)
        for c in a.children if halve_a else b.children:
            pair = (c, b) if halve_a else (a, c)
            top = bound(*pair)
            if top >= worst(pair[0]):
                stamp += 1
                heapq.heappush(heap, (-top, stamp, *pair))
    return scores, ids


def projections(dim: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((bits, dim))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each row whose id is divisible by ``every``.

    Components become floor(1024 x). Vectors that are null, empty or hold null or non-finite
    components take no part; vectors meet those of their own length only. Fewer rows than ``k`` give
    them all; ties go to the smaller id; an id never meets itself; a null id is neither query nor
    candidate; a repeated id counts once as a query (by its least vector) and each time as a candidate; an
    empty table gives an empty one. Components up to 2**20 are exact. Other columns are not read.
    """
    rows = prepared(vectors, id_col, vector_col).where("vec_id IS NOT NULL")
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("v"), F.size("v").alias("dim"))
    bits = min(62, math.ceil(math.log2(parts_for(max(1, rows.count()), BLOCK_ROWS))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                signs = matrix(part.column(1)) @ projections(dim, bits).T >= 0
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signs @ (1 << np.arange(bits, dtype=np.int64)), pa.int64())], ["vec_id", "v", "dim", "cell"])

    dealt = checkpoint(rows.mapInArrow(deal, "vec_id long, v array<long>, dim int, cell long"))
    large = dealt.groupBy("dim", "cell").count().where(F.col("count") > BLOCK_ROWS).select("dim", "cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("parts"))
    block = ["dim", "cell", "part"]
    held = dealt.join(large, ["dim", "cell"], "left").select("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "vec_id", "v")
    asked = held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", *block)).alias("q")).select(F.col("vec_id").alias("vec_id"), "q.*")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ask, have = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        if not len(ask) or not len(have):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        floor = left.column("floor").to_numpy() if "floor" in left.column_names else None
        s, i = dual_tree(matrix(left.column("v")), ask, matrix(right.column("v")), have, k, floor)
        real = (s != NONE).ravel()
        return pa.table({"query_id": np.repeat(ask, k)[real], "vec_id": i.ravel()[real], "score": s.ravel()[real]})

    result = "query_id long, vec_id long, score long"
    home = checkpoint(asked.groupBy(*block).cogroup(held.groupBy(*block)).applyInArrow(search, result))
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    known = asked.join(floors.where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))

    def outline(key: tuple, group: pa.Table) -> pa.Table:
        v = matrix(group.column("v")).astype(float)
        centre = v.mean(axis=0)
        radius = np.sqrt(((v - centre) ** 2).sum(axis=1)).max()
        return pa.table({"dim": [key[0].as_py()], "cell": [key[1].as_py()], "part": [key[2].as_py()], "centre": [centre.tolist()], "radius": [float(radius)]}, schema=_OUTLINE)

    outlines = checkpoint(held.groupBy(*block).applyInArrow(outline, "dim int, cell long, part int, centre array<double>, radius double"))
    chunks, groups = parts_for(outlines.count(), CHUNK_BLOCKS), parts_for(asked.count(), GROUP_QUERIES)
    spread = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            q, centre, radius = matrix(left.column("v")).astype(float), matrix(right.column("centre")), right.column("radius").to_numpy()
            floor, own = left.column("floor").to_numpy(), [tuple(r.values()) for r in left.select(["cell", "part"]).to_pylist()]
            length, blocks = np.sqrt((q**2).sum(axis=1)), [tuple(r.values()) for r in right.select(["cell", "part"]).to_pylist()]
            slack = 1e-9 * (1 + length.max() * (np.sqrt((centre**2).sum(axis=1)) + radius).max())
            for s in range(0, len(q), 512):
                bound = q[s : s + 512] @ centre.T + length[s : s + 512, None] * radius[None, :] + slack
                out += [(s + i, *blocks[j]) for i, j in np.argwhere(bound >= floor[s : s + 512, None]).tolist() if blocks[j] != own[s + i]]
        at, cell, part = (list(x) for x in zip(*out)) if out else ([], [], [])
        return left.select(["vec_id", "dim", "v", "floor"]).take(pa.array(at, pa.int64())).append_column("cell", pa.array(cell, pa.int64())).append_column("part", pa.array(part, pa.int32()))

    offered = known.select("dim", spread(groups, "vec_id").alias("group"), all_of(chunks).alias("chunk"), "vec_id", "v", "floor", "cell", "part")
    shown = outlines.select("dim", all_of(groups).alias("group"), spread(chunks, "cell", "part").alias("chunk"), "cell", "part", "centre", "radius")
    pairs = offered.groupBy("dim", "group", "chunk").cogroup(shown.groupBy("dim", "group", "chunk"))
    sent = checkpoint(pairs.applyInArrow(reach, "vec_id long, dim int, v array<long>, floor long, cell long, part int"))
    turns = sent.groupBy(*block).agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("turns"))
    ask = sent.join(turns, block).withColumn("turn", F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int"))
    have = held.join(turns, block).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
    key = [*block, "turn"]
    further = ask.groupBy(*key).cogroup(have.groupBy(*key)).applyInArrow(search, result)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return home.unionByName(further).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_OUTLINE = pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("part", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])
