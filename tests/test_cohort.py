"""Each rule of the frozen cohort broken alone, and the limits of the matrix and the deny list."""

import pytest
from pyspark.sql import functions as F

from tessella.functions.stats import hash_rank
from tessella.operators import cohort

ITEMS = ["q1", "q2", "q3", "q4", "q5", "q6"]


def frames(spark, models=(("m1", "o1"), ("m2", "o2"), ("m3", "o2")), listed=(("m2", "o2"), ("m1", "o1")), order=("q1", "q2", "q4", "q5", "q6"), flip=()):
    now = spark.createDataFrame([(q, k) for k, q in enumerate(order)], "item_id string, place int").withColumn("half", (hash_rank("item_id") % 2).cast("int"))
    now = now.withColumn("half", F.when(F.col("item_id").isin(*flip), 1 - F.col("half")).otherwise(F.col("half"))) if flip else now
    return (
        spark.createDataFrame(list(models), "model_id string, org_id string"), spark.createDataFrame([(*r, k) for k, r in enumerate(listed)], "model_id string, org_id string, place int"),
        now, spark.createDataFrame([(q, k) for k, q in enumerate(ITEMS)], "item_id string, place int"), spark.createDataFrame([("q3",)], "item_id string"),
    )


@pytest.mark.parametrize("change, want", [
    ({}, set()),
    ({"listed": [("m9", "o1"), ("m1", "o1")]}, {("MODEL_ABSENT", "m9")}),
    ({"listed": [("m1", "o1"), ("m1", "o1")]}, {("MODEL_REPEATED", "m1")}),
    ({"listed": [("m1", "o2")]}, {("ORG_DIFFERS", "m1")}),
    ({"order": ("q1", "q4", "q5", "q6")}, {("ITEM_LOST", "q2")}),
    ({"order": tuple(ITEMS)}, {("POLICY_ITEM_KEPT", "q3")}),
    ({"order": ("q1", "q2", "q4", "q5", "q6", "q7")}, {("ITEM_ADDED", "q7")}),
    ({"order": ("q1", "q5", "q2", "q4", "q6")}, {("ITEM_ORDER", "q2")}),
    ({"flip": ("q4",)}, {("HALF_RULE", "q4")}),
])
def test_each_rule(spark, change, want):
    args = frames(spark, **change)
    problems = cohort.cohort_problems(*args)
    assert {tuple(r) for r in problems.collect()} == want
    rows = spark.createDataFrame([("m1", 0.5), ("m2", 0.7), ("m3", 0.1)], "model_id string, acc double")
    kept = cohort.frozen_rows(rows, args[1], problems)
    if want:
        with pytest.raises(Exception, match=f"frozen cohort: {min(want)[0]}"):
            kept.collect()
    else:
        assert {(r["model_id"], r["place"]) for r in kept.collect()} == {("m2", 0), ("m1", 1)}


def test_a_model_with_too_few_cells_is_an_error(spark):
    cells = spark.createDataFrame([(f"m{m}", f"q{i}", None if m == 3 and i < 5 else 0.5) for m in range(4) for i in range(10) if (m, i) != (0, 0)], "model_id string, item_id string, lp_mean double")
    mask = spark.createDataFrame([("q9",), ("q9",)], "item_id string")
    kept = cohort.matrix_cells(cells, mask, share=0.95, least_cells=4)
    assert {r["item_id"] for r in kept.collect()} == {f"q{i}" for i in range(1, 9)}
    with pytest.raises(Exception, match="too few cells: m3"):
        cohort.matrix_cells(cells, mask, share=0.95, least_cells=5).collect()


def test_denied_items_are_counted_once(spark):
    rows = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "b"), (None, "a")], "model_id string, item_id string")
    got = cohort.relabelled(rows, spark.createDataFrame([("a",), ("a",), ("z",)], "item_id string"))
    assert {tuple(r[c] for c in ("model_id", "item_id", "n_before", "n_denied", "n_kept")) for r in got.collect()} == {("m1", "b", 2, 1, 1), ("m2", "b", 1, 0, 1)}


@pytest.mark.parametrize("name", ["frozen_rows", "cohort_problems", "cohort_summary"])
def test_the_rules_read_dimensions_not_responses(spark, sf_dir, name):
    """The responses are made once, before: no branch of the plan goes back to the lines."""
    from tessella.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "MapInArrow" not in plan
