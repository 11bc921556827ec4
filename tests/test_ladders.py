"""Covariate ladders against dense least squares and NumPy's own permutation streams, with missing values."""

import numpy as np
import pytest

from tessella.operators import ladders

NAMES = ladders.TRAITS


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    out = {}
    for bench, n in (("a", 40), ("b", 36)):
        v = {c: rng.normal(size=n) for c in NAMES}
        v["theta_c"] = v["theta_c"] + 0.7 * v["acc"] - 0.3 * v["resp"] ** 2
        v["tok_len"][[3, 8]] = np.nan  # two models without a length
        out[bench] = [f"m{i:02d}" for i in range(n)], v
    return out


@pytest.fixture(scope="module")
def traits(spark, vectors):
    rows = [(b, m, *[None if np.isnan(v[c][i]) else float(v[c][i]) for c in NAMES]) for b, (ids, v) in vectors.items() for i, m in enumerate(ids)]
    return spark.createDataFrame(rows, "bench string, model_id string, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)


def dense(v, target, covariates):
    z = {c: (v[c] - np.nanmean(v[c])) / (np.nanstd(v[c]) + 1e-12) for c in NAMES}
    x = np.column_stack([*(np.prod([z[f] for f in c.split("*")], axis=0) for c in covariates), np.ones(len(v[target]))])
    whole = np.isfinite(x).all(axis=1) & np.isfinite(v[target])
    out = np.full(len(x), np.nan)
    out[whole] = v[target][whole] - x[whole] @ np.linalg.lstsq(x[whole], v[target][whole], rcond=None)[0]
    return out


def test_residuals_equal_a_dense_solver(traits, vectors):
    got = {(r["bench"], r["rung"], r["model_id"]): r["r_theta_c"] for r in ladders.rung_residuals(traits, ["theta_c"]).collect()}
    for bench, (ids, v) in vectors.items():
        for rung, covariates in ladders.RUNGS.items():
            want = dense(v, "theta_c", covariates)
            have = np.array([np.nan if got[bench, rung, m] is None else got[bench, rung, m] for m in ids])
            assert np.allclose(have, want, atol=1e-10, equal_nan=True)


def test_nulls_follow_one_generator_through_the_rungs(traits, vectors):
    got = {(r["rung"], r["perm"]): r["r"] for r in ladders.ladder_nulls(traits, "a", "b", n_perm=30).collect()}
    shared = vectors["b"][0]  # the lesser benchmark's ids are all in the other
    n = len(shared)
    assert len(got) == 30 * len(ladders.RUNGS)
    for stream in ladders.STREAMS:
        rng = np.random.RandomState(0)
        for rung in stream:
            x, y = (dense(vectors[b][1], "theta_c", ladders.RUNGS[rung])[:n] for b in "ab")
            for k in range(30):
                moved = y[rng.permutation(n)]
                both = np.isfinite(x) & np.isfinite(moved)
                assert got[rung, k] == pytest.approx(np.corrcoef(x[both], moved[both])[0, 1], abs=1e-10)


def test_table_and_loadings(traits, vectors):
    table = {r["rung"]: r for r in ladders.ladder_table(traits, "a", "b").collect()}
    assert set(table) == set(ladders.RUNGS)
    v = vectors["a"][1]
    left = dense(v, "theta_c", ladders.RUNGS["1_acc_resp"])
    assert table["1_acc_resp"]["share_a"] == pytest.approx(left.var() / v["theta_c"].var())
    assert table["1_acc_resp"]["with_theta_a"] == pytest.approx(np.corrcoef(left, v["theta_a"])[0, 1])
    assert table["1_acc_resp"]["signs"] == "" and table["wide_acc_resp"]["signs"] in ("SAME", "NOT_SAME")
    assert all(r["n_pairs"] == 36 for r in table.values())
    got = {(r["bench"], r["name"]): r["value"] for r in ladders.loadings(traits).collect()}
    assert got["a", "theta_c~acc"] == pytest.approx(np.corrcoef(v["theta_c"], v["acc"])[0, 1])
    assert got["a", "std_tok_len"] == pytest.approx(np.nanstd(v["tok_len"]))
    wide = {r["name"]: r["value"] for r in ladders.across(traits, "a", "b").collect()}
    w = vectors["b"][1]
    assert wide["theta_c"] == pytest.approx(np.corrcoef(v["theta_c"][:36], w["theta_c"])[0, 1])
    assert wide["theta_a_left"] == pytest.approx(np.corrcoef(dense(v, "theta_a", ["acc"])[:36], dense(w, "theta_a", ["acc"]))[0, 1])


def test_what_is_explained_wholly_has_no_correlation(spark):
    rows = [(b, f"m{i}", float(i), 2.0 * i, float(i), float(i % 3), 0.1 * i, 0.0, 1.0, 0.0) for b in "ab" for i in range(9)]
    exact = spark.createDataFrame(rows, "bench string, model_id string, " + ", ".join(f"{c} double" for c in NAMES))
    got = ladders.ladder_table(exact, "a", "b", {"1_acc_resp": ["acc", "resp"]}).first()
    assert got["corr"] is None and got["with_theta_a"] is None and got["share_a"] < 1e-20
    empty = exact.limit(0)
    assert ladders.ladder_table(empty, "a", "b").count() == 0 and ladders.ladder_nulls(empty, "a", "b", n_perm=2).count() == 0
