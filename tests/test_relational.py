"""Joins that must find every id: what is unknown or contradictory stops the job."""

import pytest

from tessella.operators import relational as r
from tessella.operators import report, structure


def test_an_unknown_id_is_an_error(spark):
    order = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, position int")
    rows = spark.createDataFrame([("m", "b"), ("m", "a"), ("n", "b")], "model_id string, item_id string")
    assert sorted(tuple(x) for x in r.placed(rows, order, "item_id").select("model_id", "position").collect()) == [("m", 0), ("m", 1), ("n", 1)]
    for bad in ("c", None):
        with pytest.raises(Exception, match="unknown id"):
            r.placed(rows.union(spark.createDataFrame([("m", bad)], rows.schema)), order, "item_id").collect()


def test_targets_must_cover_and_agree(spark):
    preds = spark.createDataFrame([("m", "o", 0.5), ("n", "p", 0.25)], "model_id string, org_id string, pred double")
    targets = spark.createDataFrame([("m", "o", 1.0), ("n", "p", 0.0), ("q", "p", 0.0)], "model_id string, org_id string, y double")
    assert sorted((x["model_id"], x["org_id"], x["pred"], x["y"]) for x in r.with_truth(preds, targets).collect()) == [("m", "o", 0.5, 1.0), ("n", "p", 0.25, 0.0)]
    with pytest.raises(Exception, match="no target for model n"):
        r.with_truth(preds, targets.where("model_id <> 'n'")).collect()
    with pytest.raises(Exception, match="organisations differ for model m"):
        r.with_truth(preds, targets.replace("o", "p", ["org_id"])).collect()


def test_the_largest_reference_set_by_models_then_key(spark):
    obs = spark.createDataFrame([(m, o, i) for m, o in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "z")) for i in "12"], "model_id string, org_id string, item_id string")
    members = spark.createDataFrame([("c1", "k2", "x", "reference"), ("c1", "k2", "y", "reference"), ("c2", "k1", "z", "reference"), ("c2", "k1", "y", "reference"), ("c3", "k0", "y", "reference"), ("c3", "k0", "x", "scored")], "context string, ref_key string, org_id string, role string")
    assert [tuple(x) for x in structure.largest_reference_set(obs, members).collect()] == [("c2", "k1", 3)]


def test_headline_of_an_empty_table(spark):
    obs = spark.createDataFrame([], "model_id string, org_id string, item_id string, c double")
    halves = spark.createDataFrame([], "item_id string, half int")
    row = report.headline(obs, halves, ["c"]).first()
    assert (row["n_models"], row["n_items"], row["n_first"], row["c_min"]) == (0, 0, 0, None)


def test_key_sets(spark):
    sets = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    for a, b, want in ((("a", "a", "b"), ("b", "c"), (1, 1, False)), (("a", "b"), ("b", "a", "a"), (0, 0, True)), ((), ("x",), (0, 1, False))):
        row = r.same_set(sets(*a), sets(*b), "id").first()
        assert (row["n_left_only"], row["n_right_only"], row["equal"]) == want


def test_differences_of_infinite_cells(spark):
    """Infinities equal themselves alone, at any tolerance; NaN equals NaN, null equals null."""
    inf, nan = float("inf"), float("nan")
    a = spark.createDataFrame(list(enumerate([inf, -inf, inf, inf, nan, None, 1.0, nan])), "k int, v double")
    b = spark.createDataFrame(list(enumerate([inf, -inf, -inf, 5.0, nan, None, 1.5, 0.0])), "k int, v double")
    assert sorted(x["k"] for x in r.difference(a, b, ["k"], ["v"], atol=0.75).collect()) == [2, 3, 7]


def test_last_rows_are_found_without_a_rank_limit(spark):
    """Few rows share a key, so a rank limit would only sort them all once more before the shuffle."""
    from tessella.sources import adapters

    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "c"), (2, 1, "a"), (1, 4, "z"), (None, 3, "n"), (None, 4, "m")], "k int, o int, v string")
    last = adapters.last_row_wins(rows, ["k"], ["o", "v"])
    assert {tuple(r) for r in last.collect()} == {(1, 5, "c"), (2, 1, "a"), (None, 4, "m")}
    assert {tuple(r) for r in adapters.first_row_wins(rows, ["k"], ["o", "v"]).collect()} == {(1, 4, "z"), (2, 1, "a"), (None, 3, "n")}
    assert "WindowGroupLimit" not in last._jdf.queryExecution().toString()


def test_access_rules_read_responses_once(spark):
    """What is compared comes from the table of models, which is written once."""
    import __spark_entry__

    out = __spark_entry__.queries()["access_rules"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in out._jdf.queryExecution().toString()


def test_observations_carry_what_is_asked_for(spark):
    from tessella.operators import items
    from tessella.sources import adapters

    rows = adapters.responses_from_lineitem(spark, "/root/testdata/sf0.001")
    whole = items.valid_observations(rows)
    for some in (["ell"], ["y", "c"], []):
        part = items.valid_observations(rows, some)
        assert part.columns == ["model_id", "org_id", "item_id", *some]
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.select(*part.columns).collect()))
