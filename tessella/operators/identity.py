"""Canonical digests of tables, and the contract that a cohort of contexts has to keep.

A digest depends on the order of rows and on exact values, not on files or partitions. Rows are put in
range partitions by their order, numbered there, and hashed in blocks of fixed length; the hashes of the
blocks are hashed in blocks again until one is left. No task sees more than one block of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.structure import checkpointed

BLOCK = 1000
CELL = "\x1f"


def token(value) -> str:
    """N and the shortest exact text of a number, also of one written as text; S and the text of anything else; S alone for null."""
    if value is None:
        return "S"
    try:
        number = float(value)
    except (TypeError, ValueError):
        return f"S{value}"
    return "NNaN" if math.isnan(number) else f"N{number!r}"


def row_texts(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep.., row``: the tokens of the columns, joined. Columns are cast to text first unless they are numbers."""
    kinds = dict(rows.dtypes)
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    cast = [(F.col(c).cast("double") if kinds[c] in numeric else F.col(c).cast("string")).alias(f"_{i}") for i, c in enumerate(columns)]
    order = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    narrow = rows.select(*order, *cast)
    ddl = ", ".join([*(f"_k{i} {kinds[c]}" for i, c in enumerate(keep)), "row string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(batch.column(len(keep) + i).to_pylist() for i in range(len(columns))))
            text = pa.array([CELL.join(map(token, r)) for r in cells], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), text], [*(f"_k{i}" for i in range(len(keep))), "row"])

    return narrow.mapInArrow(run, ddl)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in the order given: counted in range partitions, whose sizes are then summed."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumn("_id", F.monotonically_increasing_id()))  # the partition above, the place in it below
    part = F.shiftright("_id", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))  # a row per partition
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("at", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")


def _hashed(rows: DataFrame, block: int) -> DataFrame:
    """One hash for each block of rows ``at, row`` in order."""
    each = rows.groupBy(F.floor(F.col("at") / block).alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("p"), "row"))).alias("r"))
    return each.select("at", F.sha2(F.array_join(F.transform("r", lambda x: x["row"]), "\n"), 256).alias("row"))


def canonical_digest(rows: DataFrame, order: list[str], columns: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``n, header, digest``, one row. Rows that are equal in ``order`` are put in order by their values.

    Values are compared exactly: 1 and 1.0 are one number, 0.1 + 0.2 is not 0.3, NaN equals NaN, null is an
    empty text. An empty table has the digest of the empty text.
    """
    columns = columns or rows.columns
    keys = [f"_k{i}" for i in range(len(order))]
    level = numbered(row_texts(rows, columns, order), [*keys, "row"]).select("at", "row")
    n = left = level.count()
    while True:
        level = checkpointed(_hashed(level, block))
        left = -(-left // block)
        if left <= 1:
            break
    header = CELL.join(map(token, columns))
    top = level.agg(F.coalesce(F.max("row"), F.sha2(F.lit(""), 256)).alias("r"))  # the last one left
    return top.select(F.lit(n).cast("long").alias("n"), F.lit(header).alias("header"), F.sha2(F.concat_ws("\n", F.lit(header), "r"), 256).alias("digest"))


def column_records(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n, nulls, nan, posinf, neginf, least, most`` of numeric columns: one pass."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        fine = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        stats.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_if(F.isnan(x)).alias("nan"), F.count_if(x == float("inf")).alias("posinf"), F.count_if(x == -float("inf")).alias("neginf"), F.min(fine).alias("least"), F.max(fine).alias("most")).alias(f"s{len(stats)}"))
    one = rows.agg(*stats)
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")


# What a cohort has to have in the published design.
OUTER, INNER, CONTEXTS = 5, 4, 125


def contract(contexts: DataFrame, cohort: DataFrame, folds: DataFrame, listed: DataFrame, outer: int = OUTER, inner: int = INNER, n_contexts: int | None = CONTEXTS) -> DataFrame:
    """``invariant, violations``, a row for each invariant, all from a few grouped passes.

    ``contexts``: as of ``crossfit.crossfit_contexts``; ``cohort``: ``model_id, org_id`` of qualified models;
    ``folds``: ``org_id, fold``; ``listed``: ``base, model_id, org_id, role``, the rows that training reads.
    """
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations")
    flag = lambda df, name, ok: df.select(F.lit(name).alias("invariant"), F.when(ok, 0).otherwise(1).cast("long").alias("violations"))
    models = cohort.groupBy("model_id").agg(F.count("*").alias("n"), F.countDistinct("org_id").alias("orgs"))
    sides = contexts.groupBy("context", "org_id").agg(F.countDistinct("role").alias("roles"), F.count("*").alias("n"))
    whole = contexts.agg(F.countDistinct("context").alias("contexts"), F.countDistinct("base").alias("bases"), F.countDistinct("outer").alias("outers"), F.countDistinct("inner").alias("inners"))
    kinds = contexts.groupBy("context").agg(F.count_if(F.col("role") == "reference").alias("r"), F.count_if(F.col("role") == "scored").alias("s"), F.countDistinct("ref_key").alias("keys"))
    sets = contexts.where("role = 'reference'").groupBy("context", "ref_key").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set("org_id"))), 256).alias("again"))
    placed = contexts.where("part = 'scored'").join(folds, "org_id", "left")
    own = F.col("fold") == F.col("outer")
    outer_rows, inner_rows = placed.where("inner IS NULL"), placed.where("inner IS NOT NULL")
    trained = contexts.where("part = 'train'").join(folds, "org_id", "left")
    asked = contexts.where("role = 'scored'").select("base", "org_id", F.when(F.col("part") == "scored", "scored").otherwise("reference").alias("role"))
    due = asked.join(cohort, "org_id").select("base", "model_id", "org_id", "role")
    tests = listed.join(contexts.where("inner IS NULL").select("base").distinct(), "base").where("role = 'scored'")
    rows = [
        count(models.where("n > 1"), "MODEL_LISTED_TWICE"), count(models.where("orgs > 1"), "IDENTITY_CONFLICT"), count(cohort.where("model_id IS NULL OR org_id IS NULL"), "IDENTITY_MISSING"),
        count(cohort.join(folds, "org_id", "left_anti"), "ORGANISATION_WITHOUT_FOLD"), count(folds.groupBy("org_id").count().where("count > 1"), "ORGANISATION_IN_TWO_FOLDS"), count(folds.where(f"fold IS NULL OR fold < 0 OR fold >= {outer}"), "FOLD_OUT_OF_RANGE"),
        flag(whole, "OUTER_FOLD_COUNT", F.col("outers") == outer), flag(whole, "INNER_FOLD_COUNT", F.col("inners") == inner), flag(whole, "BASE_CONTEXT_COUNT", F.col("bases") == outer * (inner + 1)),
        flag(whole, "PROJECTION_CONTEXT_COUNT", F.lit(True) if n_contexts is None else F.col("contexts") == n_contexts),
        count(sides.where("roles > 1"), "REFERENCE_SCORED_OVERLAP"), count(sides.where("n > 1"), "MEMBER_LISTED_TWICE"), count(contexts.where("role NOT IN ('reference', 'scored') OR role IS NULL"), "UNKNOWN_ROLE"),
        count(kinds.where("r = 0"), "EMPTY_REFERENCE_SET"), count(kinds.where("s = 0"), "NOTHING_SCORED"), count(kinds.where("keys <> 1"), "REFERENCE_KEY_CONFLICT"), count(sets.where("again <> ref_key"), "REFERENCE_KEY_MISMATCH"),
        count(outer_rows.where((F.col("role") == "scored") & ~own), "OUTER_HOLDOUT_MISMATCH"), count(outer_rows.where((F.col("role") == "reference") & own), "OUTER_TRAIN_LEAK"),
        count(inner_rows.where(own), "INNER_TRAIN_LEAK"), count(trained.where(own), "CROSSFIT_LEAK"),
        count(inner_rows.where("role = 'scored'").groupBy("outer", "org_id").agg(F.countDistinct("inner").alias("n")).where("n <> 1"), "INNER_VALIDATION_NOT_ONCE"),
        count(listed.groupBy("base", "model_id").count().where("count > 1"), "ROW_LISTED_TWICE"), count(listed.join(due, ["base", "model_id", "org_id", "role"], "left_anti"), "ROW_NOT_DUE"), count(due.join(listed, ["base", "model_id", "org_id", "role"], "left_anti"), "ROW_MISSING"),
        count(tests.groupBy("model_id").count().where("count > 1"), "EVALUATED_TWICE"), count(cohort.join(tests, "model_id", "left_anti"), "NEVER_EVALUATED"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out

