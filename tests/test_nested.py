"""The nested design against a plain version, its tie rules, and cross-fitted contexts."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import boosting, crossfit, nested, structure

RNG = np.random.default_rng(17)


def table(n=120):
    """Context-keyed rows as ``crossfit.feature_table`` makes them, with random features."""
    orgs = [f"o{i % 24}" for i in range(n)]
    outer = {o: i % 5 for i, o in enumerate(sorted(set(orgs)))}
    columns = sorted({c for p in nested.PACKAGES.values() for c in p})
    rows = []
    for k in range(5):
        train = [o for o in outer if outer[o] != k]
        inner = {o: i % 4 for i, o in enumerate(train)}
        for base, j in [(f"o{k}", None), *((f"o{k}i{j}", j) for j in range(4))]:
            for i, o in enumerate(orgs):
                if j is not None and o not in inner:
                    continue
                scored = outer[o] == k if j is None else inner[o] == j
                rng = np.random.default_rng([i, k, 9 if j is None else j])
                x = dict(zip(columns, rng.normal(size=len(columns)) + (i % 7) / 3))
                x |= {m: None for m in ("d1",)} | ({"c2": None} if i % 11 == 0 else {})
                x |= {f"m_{m}": float(x[m] is None) for m in nested.METRICS}
                rows.append({"base": base, "outer": k, "inner": j, "role": "scored" if scored else "reference", "model_id": f"m{i}", "org_id": o, "y_cal": 0.1 + (i % 7) / 20 + 0.03 * np.cos(3 * i), "y_sel": 0.3 + (i % 7) / 30 + 0.02 * np.sin(i)} | x)
    return pd.DataFrame(rows)


def plain(t, packages, targets, iterations):
    configs, out, losses = nested.CONFIGURATIONS, {}, {}

    def fitted(train, score, names, target):
        x, new = train[names].astype(float), score[names].astype(float)
        med = x.median().fillna(0.0)
        x, new = x.fillna(med).to_numpy(), new.fillna(med).to_numpy()
        size = train.groupby("org_id")["org_id"].transform("size").to_numpy()
        v = 1 / (train["org_id"].nunique() * size)
        y = train[target].to_numpy()
        mu, my = v @ x, v @ y
        sd = np.sqrt(v @ (x - mu) ** 2)
        on = sd > 1e-12
        z, new_z = (x - mu)[:, on] / sd[on], (new - mu)[:, on] / sd[on]
        preds = [np.clip(my + new_z @ np.linalg.solve(z.T @ (v[:, None] * z) + c["lam"] * np.eye(on.sum()), z.T @ (v * (y - my))), 0, 1) for c in configs if c["family"] == "ridge"]
        for c in configs:
            if c["family"] == "hgb":
                one = lambda key: np.array([c[key]])  # noqa: E731, B023
                preds.append(boosting.boost(x, y[None], v * len(v), new, one("rate"), one("leaves"), one("l2"), iterations)[0].clip(0, 1))
        return np.stack(preds)

    for k in range(5):
        mine = t[t["outer"] == k]
        for name, names in packages.items():
            for target in targets:
                wrong = []
                for j in range(4):
                    part = mine[mine["inner"] == j].sort_values("model_id")
                    score = part[part["role"] == "scored"]
                    e = (fitted(part[part["role"] == "reference"], score, names, target) - score[target].to_numpy()) ** 2
                    wrong.append(pd.DataFrame(e.T).assign(org_id=score["org_id"].to_numpy()))
                loss = pd.concat(wrong).groupby("org_id").mean().mean().to_numpy()
                part = mine[mine["inner"].isna()].sort_values("model_id")
                score = part[part["role"] == "scored"]
                preds = fitted(part[part["role"] == "reference"], score, names, target)
                for algorithm, ids in (("ridge", range(9)), ("hgb", range(9, 17)), ("best", range(17))):
                    low = [i for i in ids if loss[i] <= min(loss[list(ids)]) + 1e-12]
                    best = min(low, key=lambda i: (0, -configs[i]["lam"]) if i < 9 else (1, configs[i]["leaves"], -configs[i]["l2"], configs[i]["rate"]))
                    losses[k, name, algorithm, target] = loss[best]
                    out |= {(m, k, name, algorithm, target): p for m, p in zip(score["model_id"], preds[best])}
    return out, losses


def test_run_equals_a_plain_version(spark):
    t = table()
    packages = {"B0": nested.PACKAGES["B0"][:12], "P_c2": [*nested.PACKAGES["B0"][:12], "c2"], "P_d1": ["acc", "d1", "m_d1"]}
    types = {"base": "string", "outer": "int", "inner": "int", "role": "string", "model_id": "string", "org_id": "string"}
    schema = ", ".join(f"{c} {types.get(c, 'double')}" for c in t.columns)
    kind = {"string": str, "int": int, "double": float}
    data = [tuple(None if v is None or v != v else kind[types.get(c, "double")](v) for c, v in zip(t.columns, r)) for r in t.astype(object).itertuples(index=False)]
    rows = spark.createDataFrame(data, schema).repartition(7).cache()
    preds, chosen = nested.run(rows, packages, ("y_cal", "y_sel"), {"SP": ["B0", "P_c2", "P_d1"]}, iterations=4)
    got = {(r["model_id"], r["outer"], r["package"], r["algorithm"], r["target"]): r["pred"] for r in preds.collect()}
    want, losses = plain(t, packages, ("y_cal", "y_sel"), 4)
    assert [key for key, p in want.items() if abs(got[key] - p) > 1e-8] == []
    for r in chosen.collect():
        assert abs(losses[r["outer"], r["package"], r["algorithm"], r["target"]] - r["loss"]) < 1e-10
    for k in range(5):  # d1 is never there, so its package can't be chosen
        for target in ("y_cal", "y_sel"):
            a, b = losses[k, "B0", "best", target], losses[k, "P_c2", "best", target]
            name = "B0" if a <= min(a, b) + 1e-12 else "P_c2"
            assert all(got[m, kk, "SP", "best", t_] == got[m, kk, name, "best", t_] for m, kk, p, _, t_ in got if p == "SP" and kk == k and t_ == target)
    assert len(got) == len(want) + 120 * 2


def test_the_design_has_190_columns(spark):
    assert len(nested.PACKAGES) == 31 and [len(nested.PACKAGES[p]) for p in ("B0", "Bd", "P_a1", "Q_c1", "J")] == [29, 41, 30, 42, 49]
    assert len(nested.CONFIGURATIONS) == 17
    rows = [("m", "o", 0, p, a, t, 0.5) for p in nested.PACKAGES for a in ("ridge", "hgb", "best") for t in ("y_cal", "y_sel")] + [("m", "o", 0, p, "best", t, 0.25) for p in nested.PROCEDURES for t in ("y_cal", "y_sel")]
    one = nested.wide(spark.createDataFrame(rows, "model_id string, org_id string, outer int, package string, algorithm string, target string, pred double"))
    assert len(one.columns) == 193 and None not in one.first() and one.first()["SP_best_y_sel"] == 0.25


def test_equal_losses_are_not_transitive(spark):
    """The choice among all differs from its family's: boosting lies just within reach of the least ridge loss."""
    configs = [{"family": "ridge", "lam": 1.0}, {"family": "ridge", "lam": 10.0}, {"family": "hgb", "rate": 0.1, "leaves": 7, "l2": 1.0}, {"family": "hgb", "rate": 0.05, "leaves": 7, "l2": 1.0}]
    rows = [(0, 0, 0.9e-12), (0, 1, 1.8e-12), (0, 2, 0.0), (0, 3, 0.5e-12)]
    got = {r["algorithm"]: r["config"] for r in nested.select(spark.createDataFrame(rows, "k int, config int, loss double"), ["k"], configs).collect()}
    assert got == {"ridge": 1, "hgb": 3, "best": 0}


@pytest.fixture(scope="module")
def organisations(spark):
    return spark.range(40).selectExpr("concat('g', id) AS org_id")


def test_no_model_is_held_against_its_own_organisation(spark, organisations):
    rows = crossfit.crossfit_contexts(organisations).toPandas()
    base = structure.contexts(organisations).toPandas()
    for name, part in rows.groupby("context"):
        scored, reference = (set(part.loc[part["role"] == r, "org_id"]) for r in ("scored", "reference"))
        assert scored and reference and not scored & reference
        of = base[base["context"] == part["base"].iloc[0]]
        train = set(of.loc[of["role"] == "reference", "org_id"])
        assert (scored | reference == train) if "/aux" in name else (reference == train)
    train = rows[(rows["part"] == "train") & (rows["role"] == "scored")]
    assert not train.duplicated(["base", "org_id"]).any() and rows["context"].nunique() == 125


def test_few_organisations_leave_contexts_out(spark, organisations):
    few = crossfit.crossfit_contexts(organisations.limit(6)).toPandas()
    assert (few.groupby("context")["role"].nunique() == 2).all()
    assert crossfit.crossfit_contexts(organisations.limit(0)).count() == 0


def test_fitted_positions_follow_the_lines(spark):
    """Cells a_m - s_m b_i without noise: fitted positions, on either half, are the true ones up to scale."""
    b = np.linspace(-1.5, 1.5, 60)
    cells = [(f"m{m}", f"g{m % 6}", f"i{i}", i % 2, float(0.3 * m - (1 + m % 4) * b[i])) for m in range(36) for i in range(60)]
    obs = spark.createDataFrame(cells, "model_id string, org_id string, item_id string, half int, ell double").cache()
    members = spark.createDataFrame([("r1", f"g{k}") for k in range(4)] + [("r2", f"g{k}") for k in range(2, 6)], "ref_key string, org_id string")
    positions, status = crossfit.fitted_positions(obs, members, least_items=10, least_models=5)
    assert {r["reason"] for r in status.collect()} == {""}
    both = crossfit.with_other_half(obs, members, positions, 5).toPandas()
    assert len(both) == 2 * 2 * 60
    for _, part in both.groupby(["ref_key", "direction"]):
        assert abs(np.corrcoef(part["b"], b[part["item_id"].str[1:].astype(int)])[0, 1]) > 1 - 1e-9


def test_cells_are_not_copied_per_context(spark, sf_dir):
    """Metrics of all contexts come from one row per model: no join copies cells by context, set or direction."""
    from tessella.operators import context_sums, crossfit, structure
    from tessella.plans.crossfit_queries import _population

    obs, contexts, members = _population(spark, sf_dir)
    positions = structure.checkpointed(crossfit.start_positions(obs, members))
    cells = context_sums.packed(obs, context_sums.Numbers(obs, members))
    assert cells.count() == obs.select("model_id").distinct().count()
    for frame in (crossfit.with_other_half(obs, members, positions, cells=cells), crossfit.context_metrics(obs, contexts, positions, cells=cells)):
        assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()


def test_ranks_put_ties_at_their_mean():
    from tessella.operators import context_sums

    v, mask = np.array([[3.0, 1.0, 3.0, 9.0, 2.0]]), np.array([[True, True, True, False, True]])
    assert context_sums._ranks(v, mask)[0, [0, 1, 2, 4]].tolist() == [3.5, 1.0, 3.5, 2.0]
