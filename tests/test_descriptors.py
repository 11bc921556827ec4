"""Hand-checked constants of the descriptors, and oracles on the small tables."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import descriptors as d
from tessella.operators import items

RAW = "model_id string, org_id string, item_id string, loglik array<double>, char_lens array<double>, gold double, n_options int, n_tokens double"


def responses(spark, rows):
    """rows: (item, scores, gold) or (item, scores, gold, lengths)."""
    return spark.createDataFrame([("m", "o", r[0], [None if x is None else float(x) for x in r[1]], [float(x) if x is not None else None for x in (r[3] if len(r) > 3 else [1] * len(r[1]))], float(r[2]), len(r[1]), 1.0) for r in rows], RAW)


def observed(spark, rows):
    return items.valid_observations(responses(spark, rows))


def logs(*p):
    return [math.log(x) for x in p]


def test_all_metrics_of_four_items(spark):
    """Fixed values of the published example: two items at confidence 0.9 (b right, a wrong), two at 0.6 (d right, c wrong)."""
    r = d.ab_metrics(observed(spark, [("b", logs(0.9, 0.1), 0), ("a", logs(0.9, 0.1), 1), ("d", logs(0.6, 0.4), 0), ("c", logs(0.6, 0.4), 1)])).first()
    gaps = [math.log(0.9 / 0.1), math.log(0.6 / 0.4)]  # of the two wrong items
    expected = {
        "a1": 0.5,  # confidence does not tell right from wrong
        "a2": (1 + 1 / 2 + 2 / 3 + 1 / 2) / 4,  # running error of a, b, c, d: equal confidence goes by name
        "a3": 0,  # both bins are half right
        "a4": 1, "a5": 1,  # the first of four is wrong
        "b1": -sum(map(math.log, (0.9, 0.1, 0.6, 0.4))) / 4,
        "b2": (0.9 + 0.6) / 4, "b3": (0.9**2 + 0.6**2) / 4,
        "b4": sum(gaps) / 4, "b5": max(gaps),
        "b6": 1 / 2,  # of two options the other one comes first when wrong
        "b7": 0,  # one option is left besides the winner
    }
    assert {k: r[k] for k in expected} == pytest.approx(expected, abs=1e-12)


def test_metrics_of_uneven_items(spark):
    """Five items of three options, against sums written out row by row."""
    scores = [([2.0, 0.0, 1.0], 0), ([0.0, 3.0, 0.0], 1), ([1.0, 1.5, 0.0], 0), ([0.2, 0.1, 0.0], 2), ([0.0, 0.0, 4.0], 0)]
    r = d.ab_metrics(observed(spark, [(f"i{k}", s, g) for k, (s, g) in enumerate(scores)])).first()
    rows = []
    for k, (s, g) in enumerate(scores):
        whole = sum(map(math.exp, s))
        rows.append((-max(map(math.exp, s)) / whole, f"i{k}", float(s.index(max(s)) != g), max(s) - s[g], math.log(whole) - s[g]))
    rows.sort()
    wrong = [e for _, _, e, _, _ in rows]
    assert r["a2"] == pytest.approx(sum(sum(wrong[: k + 1]) / (k + 1) for k in range(5)) / 5)
    assert (r["a4"], r["a5"]) == pytest.approx((wrong[0], sum(wrong[:2]) / 2))
    assert (r["b1"], r["b4"], r["b5"]) == pytest.approx((sum(x[4] for x in rows) / 5, sum(x[3] for x in rows) / 5, max(x[3] for x in rows)))
    assert (r["b2"], r["b3"]) == pytest.approx((sum(-c * e for c, _, e, _, _ in rows) / 5, sum(c * c * e for c, _, e, _, _ in rows) / 5))


@pytest.mark.parametrize("scores,gold,a1", [([[2, 0], [1, 0]], [0, 1], 1.0), ([[1, 0], [2, 0]], [0, 1], 0.0), ([[2, 0], [1, 0]], [0, 0], None)])
def test_auroc(spark, scores, gold, a1):
    r = d.auroc(observed(spark, [(str(i), s, g) for i, (s, g) in enumerate(zip(scores, gold))])).first()
    assert r["a1"] == a1 and r["a1_reason"] == ("SINGLE_CLASS" if a1 is None else "")


def test_ties_go_to_the_first_option(spark):
    rows = {r["item_id"]: r for r in observed(spark, [(str(k), [0.0] * k, g) for k, g in ((2, 0), (3, 1), (4, 3), (5, 4))]).collect()}
    assert [rows[k]["y"] for k in "2345"] == [True, False, False, False]
    assert [rows[k]["depth"] for k in "2345"] == [0, 0.5, 1, 1]
    assert [rows[k]["hn"] for k in "2345"] == pytest.approx([0, 1, 1, 1])
    assert all(rows[k]["z"] == 0 for k in "2345")


def test_extreme_scores_do_not_underflow(spark):
    r = observed(spark, [("a", [0.0, -10001.0, -10000.0], 1)]).first()
    p = 1 / (1 + math.exp(-1))
    assert r["nll"] == r["z"] == 10001 and r["depth"] == 1 and r["c"] == 1
    assert r["hn"] == pytest.approx(-(p * math.log(p) + (1 - p) * math.log(1 - p)) / math.log(2))


def test_scores_count_per_character(spark):
    assert observed(spark, [("a", [-1.0, -2.0], 1, [1, 4])]).first()["y"]


def test_resolution_at_bin_edges(spark):
    c = [0.1, math.nextafter(0.1, 0), 0.9, 1.0]
    obs = spark.createDataFrame([("m", str(i), x, bool(g)) for i, (x, g) in enumerate(zip(c, (0, 1, 0, 1)))], "model_id string, item_id string, c double, y boolean")
    assert d.resolution(obs).first()["a3"] == pytest.approx(0.125)


def test_floor_and_edge_bins_differ_only_at_machine_edges(spark):

    from tessella.functions.stats import edge_bin, equal_bin

    xs = [y for j in range(1, 10) for y in (math.nextafter(j / 10, 0), j / 10, math.nextafter(j / 10, 1))] + [0.0, 1.0]
    got = spark.createDataFrame([(x,) for x in xs], "c double").select("c", equal_bin("c").alias("f"), edge_bin("c").alias("e")).collect()
    assert [r["f"] for r in got] == [min(int(math.floor(x * 10)), 9) for x in xs]
    assert [r["e"] for r in got] == [max([j for j in range(10) if x >= j / 10]) for x in xs]



def test_largest_losses(spark):
    obs = observed(spark, [(f"{i:02d}", [math.log(9), 0.0], 1 if i == 0 else 0) for i in range(11)])
    assert d.top_loss(obs).first()["b5"] == pytest.approx(math.log(9) / 2)
    one = d.ranked_risk(observed(spark, [("a", [1.0, 0.0], 1)])).first()
    assert one["a2"] == one["a4"] == one["a5"] == 1


def test_validity_names_every_reason(spark):
    inf = float("inf")
    rows = responses(spark, [("good", [0, 1], 0), ("pad", [0, 1, 2], 0, [1, 1, None]), ("zero", [0, 1], 0, [1, 0]), ("inf", [0, inf], 0), ("half", [0, 1], 1.5)])
    got = {r["item_id"]: (r["valid"], r["reasons"]) for r in items.validity(rows).collect()}
    assert got["good"] == (True, [])
    assert got["pad"] == (False, ["padding_has_loglik", "n_options_disagrees"])
    assert got["zero"] == (False, ["bad_char_length", "fewer_than_two_options", "n_options_disagrees"])
    assert got["inf"] == (False, ["incomplete_real_loglik"]) and got["half"] == (False, ["invalid_gold"])


def test_summaries_of_two_items(spark):
    obs = observed(spark, [("a", logs(0.8, 0.2), 0), ("b", logs(0.6, 0.4), 1)])
    m, c, r = d.means(obs).first(), d.calibration(obs).first(), d.ranked_risk(obs).first()
    h = lambda p: -(p * math.log(p) + (1 - p) * math.log(1 - p)) / math.log(2)
    got = (m["acc"], m["conf"], m["over"], c["rel10"], r["r50"], c["ece10"], m["brier"], m["h"], m["margin"])
    assert got == pytest.approx((0.5, 0.7, 0.2, 0.2, 0, 0.4, 0.4, (h(0.8) + h(0.6)) / 2, 0.4))
    even = observed(spark, [("a", [0.0, 0.0, 0.0], 0)])
    m, c = d.means(even).first(), d.calibration(even).first()
    assert (m["brier"], m["h"], m["margin"], c["rel10"], c["ece10"]) == pytest.approx((2 / 3, 1, 0, 4 / 9, 2 / 3))


def test_risk_at_full_coverage_is_the_error_rate(spark, sf_dir):
    from tessella.sources.adapters import responses_from_lineitem

    obs = items.valid_observations(responses_from_lineitem(spark, sf_dir))
    for r in d.ranked_risk(obs).join(d.means(obs), "model_id").collect():
        assert r["r100"] == pytest.approx(1 - r["acc"])


def test_padded_options_are_no_options(spark):
    """Three options, the third of them padding, are scored like two."""
    plain = observed(spark, [("a", [0.3, -0.7], 1)])
    padded = items.valid_observations(responses(spark, [("a", [0.3, -0.7, None], 1, [1, 1, None])]).withColumn("n_options", F.lit(2)))
    assert plain.collect() == padded.collect() and None not in plain.first()


def test_scores_are_worked_out_once(spark, sf_dir):
    """Nested array functions repeat what they are given: no plan of observations or cells may hold them."""
    from tessella.sources.adapters import responses_from_lineitem

    for frame in (items.valid_observations(responses_from_lineitem(spark, sf_dir)), items.cells(responses_from_lineitem(spark, sf_dir))):
        assert "lambdafunction" not in frame._jdf.queryExecution().executedPlan().toString()
