"""Reference populations, fits and residual shape on hand-checked and rank-one data."""

import math

import numpy as np
import pytest

from tessella.operators import structure as s


def test_ease_is_organisation_equal(spark):
    rows = [(f"m{i}", "big", "a", 1.0) for i in range(19)] + [("x", "small", "a", 0.0)] + [(f"m{i}", "big", "b", 1.0) for i in range(19)]
    obs = spark.createDataFrame(rows, "model_id string, org_id string, item_id string, e double")
    members = spark.createDataFrame([("r", "big"), ("r", "small")], "ref_key string, org_id string")
    got = {r["item_id"]: r for r in s.reference_ease(obs, members).collect()}
    assert got["a"]["w"] == pytest.approx((0.025 + 0.75) / 2) and got["b"]["w"] is None
    assert (got["a"]["n_ref"], got["b"]["n_ref"]) == (20, 19)


def test_c_metrics_of_five_items(spark):
    rows = [("m", i, 0.1 * (k + 1), 1.0, False, float(k)) for k, i in enumerate("bacde")]
    obs = spark.createDataFrame(rows, "model_id string, item_id string, c double, e double, y boolean, z double")
    ease = spark.createDataFrame([(i, 0.5) for i in "abcde"], "item_id string, w double")
    r = s.c_metrics(obs, ease, ["model_id"]).first()
    assert (r["c1"], r["c2"], r["c3"], r["c4"]) == pytest.approx((0.5, 0.15, 1, 0.019))
    assert s.c_metrics(obs.where("item_id <> 'e'"), ease, ["model_id"]).first()["c4"] == pytest.approx(0.0125)
    assert s.c_metrics(obs.where("item_id < 'd'"), ease, ["model_id"]).first()["c4"] is None


@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_residual_shape(spark, scale):
    rows = [("m", str(i), r * scale, float(b)) for i, (r, b) in enumerate(zip((-2, -1, 1, 2), (-2, -1, 1, 3)))]
    schema = "model_id string, item_id string, r double, b double"
    r = s.residual_shape(spark.createDataFrame(rows, schema), ["model_id"]).first()
    assert (r["d1"], r["d2"], r["d3"]) == pytest.approx((0.5, -1.64, 0))
    if scale == 1:
        assert r["d4"] == pytest.approx(2.5 / math.sqrt(2.5 * 10.6875))
        flat = s.residual_shape(spark.createDataFrame([("m", str(i), 0.0, float(i)) for i in range(4)], schema), ["model_id"]).first()
        assert flat["d1"] is flat["d2"] is flat["d3"] is flat["d4"] is None


def test_projection_of_a_line(spark):
    b = np.linspace(-1, 1, 100)
    noise = np.tile([0.2, -0.2, -0.2, 0.2], 25)
    def fit(ell, n=100):
        rows = [("m", str(i), float(e), float(x)) for i, (e, x) in enumerate(zip(ell[:n], b[:n]))]
        return s.project_source(spark.createDataFrame(rows, "model_id string, item_id string, ell double, b double"), ["model_id"]).first()

    noise = noise - np.polyval(np.polyfit(b, noise, 1), b)
    noise *= 0.2 / np.sqrt((noise**2).mean())
    r = fit(0.3 - 1.2 * b + noise)
    assert (r["a"], r["s"], r["sigma"], r["theta"], r["reason"]) == (pytest.approx(0.3), pytest.approx(1.2), pytest.approx(0.2), pytest.approx(0.25), "")
    assert fit(0.3 - 1.2 * b + noise, 99)["reason"] == "EVALUATION_ITEMS_LT100"
    assert fit(0.3 + 1.2 * b + noise)["reason"] == "S_LE1E8"
    assert fit(0.3 - 1.2 * b)["reason"] == "SIGMA_LE1E8"


def test_fit_recovers_rank_one_data(spark):
    rng = np.random.default_rng(5)
    b, slope, a = rng.normal(size=200), rng.uniform(0.5, 2, 22), rng.normal(size=22)
    rows = [(0, f"m{m}", f"i{i:03d}", float(a[m] - slope[m] * b[i])) for m in range(22) for i in range(200)] + [(1, f"m{m}", f"i{i}", 0.0) for m in range(22) for i in range(120)] + [(2, "m0", "i0", 1.0)]
    items, models, status = s.als_reference(spark.createDataFrame(rows, "k int, model_id string, item_id string, ell double"), ["k"])
    got = {r["k"]: r["reason"] for r in status.collect()}
    assert got == {0: "", 1: "DEGENERATE_REFERENCE_INIT", 2: "INSUFFICIENT_REFERENCE_ITEMS"}
    found = np.array([r["b"] for r in items.where("k = 0").orderBy("item_id").collect()])
    assert np.abs(found - (b - b.mean()) / b.std()).max() < 1e-9
    lines = {r["model_id"]: (r["a"], r["s"]) for r in models.collect()}
    assert all(lines[f"m{m}"] == (pytest.approx(a[m] - slope[m] * b.mean()), pytest.approx(slope[m] * b.std())) for m in range(22))


def test_contexts_split_organisations(spark):
    orgs = spark.createDataFrame([(f"o{i}",) for i in range(23)], "org_id string")
    rows = s.contexts(orgs).collect()
    outer = [r for r in rows if r["inner"] is None]
    assert sorted(r["org_id"] for r in outer if r["role"] == "scored") == sorted(f"o{i}" for i in range(23))
    for c in {r["context"] for r in rows}:
        part = [r for r in rows if r["context"] == c]
        assert len({r["org_id"] for r in part}) == len(part) and len({r["ref_key"] for r in part}) == 1
    assert len({r["context"] for r in rows}) == 25


def test_set_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("b",), ("a",), ("b",)], "x string")
    got = df.agg(s.set_hash("x").alias("p"), s.set_hash("x", True).alias("q")).first()
    assert got["p"] == hashlib.sha256(b"a\nb").hexdigest() and got["q"] == hashlib.sha256(b"a\nb\n").hexdigest()


def test_rounds_of_a_fit_pass_whole_models(spark, monkeypatch):
    """Cells meet lines inside tasks, and groups that fail or don't take part are told apart."""
    rng = np.random.default_rng(8)
    b, slope, a = rng.normal(size=110), rng.uniform(0.5, 2, 24), rng.normal(size=24)
    rows = [(k, f"m{m}", f"q{i}", float(a[m] - slope[m] * b[i] * (k + 1))) for k in (0, 1) for m in range(24) for i in range(110) if (m + i) % 13]
    rows += [(2, f"m{m}", f"q{i}", float(i)) for m in range(24) for i in range(5)]  # few items
    rows += [(3, f"m{m}", f"q{i}", 1.0) for m in range(24) for i in range(110)]  # no spread
    passes = []
    kept = s._position_sums
    monkeypatch.setattr(s, "_position_sums", lambda models, b: passes.append((models.count(), len(b))) or kept(models, b))
    items, models, status = s.als_reference(spark.createDataFrame(rows, "k int, model_id string, item_id string, ell double"), ["k"], tol=1e-10)
    assert {r["k"]: r["reason"] for r in status.collect()} == {0: "", 1: "", 2: "INSUFFICIENT_REFERENCE_ITEMS", 3: "DEGENERATE_REFERENCE_INIT"}
    assert passes and set(passes) == {(48, 220)}
    at = {(r["k"], r["item_id"]): r["b"] for r in items.collect()}
    want = (b - b.mean()) / b.std()
    assert all(np.allclose([at[k, f"q{i}"] for i in range(110)], want, atol=1e-7) for k in (0, 1))
    line = {(r["k"], r["model_id"]): (r["a"], r["s"]) for r in models.collect()}
    assert np.allclose([line[1, f"m{m}"] for m in range(24)], np.column_stack([a - 2 * slope * b.mean(), 2 * slope * b.std()]), atol=1e-6)
