"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join whose hot side
adaptive execution can split, so a node with very many links is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by stars of the same connectivity."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        stars = [(x, r) for x in list(parent) if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], pa.int64()) for i in (0, 1)], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` whose component has a smaller node.

    The component id is its smallest node; that node itself is not listed. Null ends, loops and
    repeated links are ignored; no links give an empty table. Raises if ``max_rounds`` do not do.
    """
    links = edges.select(F.least(a, b).cast("long").alias("v"), F.greatest(a, b).cast("long").alias("u")).where("u > v")
    stars = links.select("u", "v").mapInArrow(_local_forest, "u long, v long").distinct()
    seen = None
    for _ in range(max_rounds):
        stars = checkpoint(stars)
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        stars = _small_star(_large_star(stars).where("u > v").distinct()).distinct()
    raise RuntimeError("the components did not settle")
