"""Transfer against NumPy, digests against hashlib, the store of directions, and a broken fixture for each invariant."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import crossfit, identity, transfer

RNG = np.random.default_rng(29)


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_quadrature_and_bisection():
    b, s, theta = RNG.normal(size=50), RNG.uniform(0.3, 2, 20), RNG.normal(size=20)
    acc = sigmoid(s[:, None] * (theta[:, None] - b)).mean(1)
    assert np.abs(transfer.invert(acc, s, b) - theta).max() < 1e-9
    nodes = transfer.logistic_nodes()
    assert len(nodes) == 64 and np.abs(nodes + nodes[::-1]).max() < 1e-12 and abs(np.mean(nodes**2) - np.pi**2 / 3) < 0.2


def population(n_models=60, n_items=80):
    b = np.linspace(-1.5, 1.5, n_items)
    s, theta = RNG.uniform(0.6, 1.8, n_models), RNG.normal(size=n_models) * 0.6
    ell = 1.4 * s[:, None] * (theta[:, None] - b) + RNG.normal(size=(n_models, n_items)) * 0.1
    names, orgs = [f"m{i:02d}" for i in range(n_models)], [f"g{i % 12:02d}" for i in range(n_models)]
    target = pd.DataFrame([(names[m], orgs[m], f"i{i}", float(ell[m, i])) for m in range(n_models) for i in range(n_items)], columns=["model_id", "org_id", "item_id", "ell"])
    source = pd.DataFrame({"model_id": names, "org_id": orgs, "theta": theta, "s": s})
    return source, target, ell


@pytest.mark.parametrize("fitted", [False, True])
def test_transfer_equals_a_dense_version(spark, fitted):
    source, target, ell = population()
    limits = {"least_models": 5, "least_items": 10} if fitted else {"least_models": 5}
    got = transfer.transfer(spark.createDataFrame(source.values.tolist(), "model_id string, org_id string, theta double, s double"), spark.createDataFrame(target.values.tolist(), "model_id string, org_id string, item_id string, ell double"), fitted=fitted, **limits).toPandas()
    assert len(got) == 60 * 3
    orgs = sorted(set(source["org_id"]))
    fold = {orgs[g]: k % 2 for k, g in enumerate(np.random.default_rng(transfer.SEED).permutation(12))}
    f = source["org_id"].map(fold).to_numpy()
    s, theta = source["s"].to_numpy(), source["theta"].to_numpy()
    acc = (ell > 0).mean(1)
    over = sigmoid(np.abs(ell)).mean(1) - acc
    for scored in (0, 1):
        est = ell[f != scored]
        b = -est.mean(0)
        b = (b - b.mean()) / b.std()
        for _ in range(500 if fitted else 1):
            c = est - est.mean(1, keepdims=True)
            line = -(c @ (b - b.mean())) / ((b - b.mean()) ** 2).sum()
            level = est.mean(1) + line * b.mean()
            new = (line[:, None] * (level[:, None] - est)).sum(0) / (line**2).sum()
            new = (new - new.mean()) / new.std()
            if fitted:
                done = np.abs(new - b).max() < 1e-6
                b = new
                if done:
                    c = est - est.mean(1, keepdims=True)
                    line = -(c @ b) / (b**2).sum()
                    break
        scale = np.exp(np.mean(np.log(line) - np.log(s[f != scored])))
        for v, slope in (("rescale", scale * s), ("median", np.full(60, scale * np.median(s[f != scored]))), ("literal", s)):
            mine = got[(got["variant"] == v) & (got["fold"] == scored)].sort_values("model_id")
            at = np.flatnonzero(f == scored)
            assert mine["model_id"].tolist() == source["model_id"].iloc[at].tolist()
            assert np.abs(mine["acc"].to_numpy() - acc[at]).max() < 1e-12 and np.abs(mine["over"].to_numpy() - over[at]).max() < 1e-12
            tol = 2e-5 if fitted else 1e-9
            assert np.abs(mine["pred_acc"].to_numpy() - sigmoid(slope[at, None] * (theta[at, None] - b)).mean(1)).max() < tol
            there = transfer.invert(acc[at], slope[at], b)
            sure = np.mean([sigmoid(np.abs(slope[at, None] * (there[:, None] - b) + e)).mean(1) for e in transfer.logistic_nodes()], 0)
            assert np.abs(mine["pred_over"].to_numpy() - (sure - acc[at])).max() < 10 * tol


def test_products_of_exponentials_equal_plain_logistics():
    """Flat, negative, steep and overflowing slopes: rows that products would overflow are taken plainly."""
    rng = np.random.default_rng(3)
    b, nodes = np.sort(rng.normal(size=40)), transfer.logistic_nodes()
    s = np.array([0.0, -1.0, 0.3, 2.0, 9.0, 40.0, 1e3, np.nan])
    theta = rng.normal(size=len(s))
    plain = lambda x: 1 / (1 + np.exp(np.clip(-x, None, 700)))
    acc = plain(s[:, None] * (theta[:, None] - b)).mean(1)
    low, high = np.full(len(s), -transfer.REACH), np.full(len(s), transfer.REACH)
    for _ in range(transfer.STEPS):
        mid = (low + high) / 2
        under = plain(s[:, None] * (mid[:, None] - b)).mean(1) < acc
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    with np.errstate(all="raise", under="ignore"):
        got = transfer.invert(acc, s, b)
    rising = s > 0
    assert np.abs(got - (low + high) / 2)[rising].max() < 1e-9 and (got[~rising] == ((low + high) / 2)[~rising])[1:].all()
    x = s[:-1, None] * (theta[:-1, None] - b)
    assert np.abs(transfer.confidence(x, nodes) - np.mean([plain(np.abs(x + e)).mean(1) for e in nodes], 0)).max() < 1e-12


def test_bisection_is_spread_over_tasks(spark):
    """Rows of a few bytes and much work must not be coalesced into a task or two."""
    rows = spark.range(64).select(F.col("id").cast("string").alias("model_id"), F.lit(0).alias("fold"), F.lit(0.1).alias("theta"), F.lit(0.6).alias("acc"), *(F.lit(1.0).alias(f"s_{v}") for v in transfer.VARIANTS))
    places = spark.range(30).select(F.lit(0).alias("fold"), F.col("id").cast("string").alias("item_id"), (F.col("id") / 30).alias("b"))
    out = transfer.predicted(rows.join(spark.range(64).select(F.col("id").cast("string").alias("model_id")), "model_id"), places).select(F.spark_partition_id().alias("p")).distinct()
    assert out.count() > spark.sparkContext.defaultParallelism


def test_intervals_equal_a_gather(spark):
    n = 90
    t = pd.DataFrame({"model_id": [f"m{i}" for i in range(n)], "org_id": [f"g{i % 9}" for i in range(n)], "fold": 0, "acc": RNG.uniform(size=n), "over": RNG.normal(size=n)})
    rows, preds = [], {}
    for v in transfer.VARIANTS:
        preds[v] = (t["acc"] + RNG.normal(size=n) * 0.2, t["over"] + RNG.normal(size=n) * 0.3)
        rows += [(m, o, 0, v, a, w, float(p), float(q)) for m, o, a, w, p, q in zip(t["model_id"], t["org_id"], t["acc"], t["over"], *preds[v])]
    table = spark.createDataFrame(rows, "model_id string, org_id string, fold int, variant string, acc double, over double, pred_acc double, pred_over double")
    got = {r["measure"]: (r["low"], r["high"]) for r in transfer.r2_intervals(table, n_boot=200).collect()}
    orgs = sorted(set(t["org_id"]))
    draws = np.random.default_rng(transfer.SEED).integers(0, 9, size=(200, 9))
    share = lambda y, p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    stat = {"r2_acc_median": [], "gain_over": []}
    for pick in draws:
        at = np.concatenate([np.flatnonzero(t["org_id"] == orgs[j]) for j in pick])
        y, w = t["acc"].to_numpy()[at], t["over"].to_numpy()[at]
        stat["r2_acc_median"].append(share(y, preds["median"][0].to_numpy()[at]))
        stat["gain_over"].append(share(w, preds["rescale"][1].to_numpy()[at]) - share(w, preds["median"][1].to_numpy()[at]))
    for name, values in stat.items():
        assert np.allclose(got[name], np.percentile(values, [2.5, 97.5]), atol=1e-9)


def test_stored_directions_are_fitted_once(spark, tmp_path):
    cells = [(f"m{m}", f"g{m % 6}", f"i{i}", i % 2, float(m - i)) for m in range(24) for i in range(20)]
    schema = "model_id string, org_id string, item_id string, half int, ell double"
    obs = spark.createDataFrame(cells, schema).cache()
    sets = lambda *keys: spark.createDataFrame([(k, f"g{j}") for k in keys for j in range(6) if str(j) not in k], "ref_key string, org_id string")
    seen = []
    start = lambda o, m: (seen.append(sorted(r[0] for r in m.select("ref_key").distinct().collect())), crossfit.start_positions(o, m, 5))[1]
    first, n = crossfit.cached_positions(obs, sets("r0", "r1"), str(tmp_path), start)
    want = sorted(map(tuple, first.collect()))
    assert n == 2 and len(want) == 2 * 20
    again, n = crossfit.cached_positions(obs, sets("r1", "r0"), str(tmp_path), start)
    assert n == 0 and sorted(map(tuple, again.collect())) == want
    more, n = crossfit.cached_positions(obs, sets("r0", "r2"), str(tmp_path), start)
    assert n == 1 and more.select("ref_key").distinct().count() == 2
    changed = spark.createDataFrame([(*c[:4], c[4] + 0.5 * (c[2] == "i3")) for c in cells], schema)
    _, n = crossfit.cached_positions(changed, sets("r0"), str(tmp_path), start)
    assert n == 1 and seen == [["r0", "r1"], ["r2"], ["r0"]]


def plain_digest(rows, columns, block):
    level = [identity.CELL.join(map(identity.token, r)) for r in rows]
    while True:
        level = [hashlib.sha256("\n".join(level[i : i + block]).encode()).hexdigest() for i in range(0, len(level), block)]
        if len(level) <= 1:
            break
    header = identity.CELL.join(map(identity.token, columns))
    return hashlib.sha256((header + "\n" + (level[0] if level else hashlib.sha256(b"").hexdigest())).encode()).hexdigest()


@pytest.mark.parametrize("n,block", [(0, 4), (1, 4), (4, 4), (5, 4), (70, 4), (300, 1000)])
def test_digest_depends_on_order_and_exact_values(spark, n, block):
    values = [0.1 + 0.2, 0.3, float("nan"), float("inf"), -0.0, 1e-7, 1e300, None, 5.0]
    rows = [(i, values[i % 9], ["é", None, "12", "1.50", "x\ny"][i % 5]) for i in range(n)]
    schema = "k long, x double, row string"
    digest = lambda data: identity.canonical_digest(spark.createDataFrame(data, schema).repartition(5), ["k"], block=block).first()
    got = digest(rows[::-1])
    assert (got["n"], got["digest"]) == (n, plain_digest(rows, ["k", "x", "row"], block))
    if n > 3:
        moved = [(0, *rows[1][1:]), (1, *rows[0][1:]), *rows[2:]]
        assert digest(moved)["digest"] != got["digest"]
    assert identity.token("1.50") == identity.token(1.5) == "N1.5" and identity.token(None) == "S" and identity.token("nan") == "NNaN"


def test_column_records(spark):
    t = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (-3.0,)], "x double")
    assert tuple(identity.column_records(t, ["x"]).first()) == ("x", 5, 1, 1, 1, 0, -3.0, 1.0)


@pytest.fixture(scope="module")
def cohort(spark):
    orgs = spark.range(40).selectExpr("concat('g', id) AS org_id")
    contexts = crossfit.crossfit_contexts(orgs).toPandas()
    from tessella.operators import structure

    folds = structure.folds(orgs, 5).toPandas()
    models = pd.DataFrame([(f"m{i}", f"g{i % 40}") for i in range(100)], columns=["model_id", "org_id"])
    asked = contexts[contexts["role"] == "scored"]
    listed = asked.assign(role=np.where(asked["part"] == "scored", "scored", "reference"))[["base", "org_id", "role"]].merge(models, on="org_id")[["base", "model_id", "org_id", "role"]]
    return contexts, models, folds, listed


def violations(spark, contexts, models, folds, listed):
    kinds = ["context string, base string, outer int, inner int, part string, org_id string, role string, ref_key string", "model_id string, org_id string", "org_id string, fold int", "base string, model_id string, org_id string, role string"]
    clean = lambda d: [tuple(None if v is None or v != v else int(v) if c in ("outer", "inner", "fold") else v for c, v in zip(d.columns, r)) for r in d.itertuples(index=False)]
    tables = [spark.createDataFrame(clean(d), k) for d, k in zip((contexts, models, folds, listed), kinds)]
    return {r["invariant"]: r["violations"] for r in identity.contract(*tables).collect()}


def broken(name, contexts, models, folds, listed):
    c, m, f, rows = contexts.copy(), models.copy(), folds.copy(), listed.copy()
    outer_ref = c.index[c["inner"].isna() & (c["part"] == "scored") & (c["role"] == "reference")]
    outer_sco = c.index[c["inner"].isna() & (c["part"] == "scored") & (c["role"] == "scored")]
    inner_sco = c.index[c["inner"].notna() & (c["part"] == "scored") & (c["role"] == "scored")]
    aux = c.index[c["part"] == "train"]
    name_of = lambda k: f.loc[f["fold"] == k, "org_id"].iloc[0]
    if name in ("MODEL_LISTED_TWICE", "IDENTITY_CONFLICT"):
        m = pd.concat([m, pd.DataFrame([("m0", "g0" if name == "MODEL_LISTED_TWICE" else "g7")], columns=m.columns)])
    elif name == "IDENTITY_MISSING":
        m = pd.concat([m, pd.DataFrame([(None, "g0")], columns=m.columns)])
    elif name == "ORGANISATION_WITHOUT_FOLD":
        f = f.iloc[1:]
    elif name == "ORGANISATION_IN_TWO_FOLDS":
        f = pd.concat([f, f.iloc[:1]])
    elif name == "FOLD_OUT_OF_RANGE":
        f.loc[f.index[0], "fold"] = 9
    elif name == "OUTER_FOLD_COUNT":
        c = c[c["outer"] != 4]
    elif name == "INNER_FOLD_COUNT":
        c = c[~(c["inner"] == 3)]
    elif name == "BASE_CONTEXT_COUNT":
        c = c[c["base"] != "o1i2"]
    elif name == "PROJECTION_CONTEXT_COUNT":
        c = c[c["context"] != "o1i2/aux3"]
    elif name == "REFERENCE_SCORED_OVERLAP":
        c = pd.concat([c, c.loc[outer_ref[:1]].assign(role="scored")])
    elif name == "MEMBER_LISTED_TWICE":
        c = pd.concat([c, c.loc[outer_ref[:1]]])
    elif name == "UNKNOWN_ROLE":
        c.loc[outer_ref[0], "role"] = "other"
    elif name == "EMPTY_REFERENCE_SET":
        c = c[~((c["context"] == "o2/scored") & (c["role"] == "reference"))]
    elif name == "NOTHING_SCORED":
        c = c[~((c["context"] == "o2/scored") & (c["role"] == "scored"))]
    elif name in ("REFERENCE_KEY_CONFLICT", "REFERENCE_KEY_MISMATCH"):
        c.loc[outer_ref[0], "ref_key"] = "0"
    elif name == "OUTER_HOLDOUT_MISMATCH":
        k = c.loc[outer_sco[0], "outer"]
        c.loc[outer_sco[0], "org_id"] = name_of((k + 1) % 5)
    elif name == "OUTER_TRAIN_LEAK":
        c.loc[outer_ref[0], "org_id"] = name_of(c.loc[outer_ref[0], "outer"])
    elif name in ("INNER_TRAIN_LEAK", "INNER_VALIDATION_NOT_ONCE"):
        c.loc[inner_sco[0], "org_id"] = name_of(c.loc[inner_sco[0], "outer"]) if name == "INNER_TRAIN_LEAK" else c.loc[inner_sco[-1], "org_id"]
        if name == "INNER_VALIDATION_NOT_ONCE":
            c.loc[inner_sco[0], ["outer", "org_id"]] = [c.loc[inner_sco[-1], "outer"], c.loc[inner_sco[-1], "org_id"]]
    elif name == "CROSSFIT_LEAK":
        c.loc[aux[0], "org_id"] = name_of(c.loc[aux[0], "outer"])
    elif name == "ROW_LISTED_TWICE":
        rows = pd.concat([rows, rows.iloc[:1]])
    elif name == "ROW_NOT_DUE":
        rows = pd.concat([rows, pd.DataFrame([("o0", "stranger", "g0", "scored")], columns=rows.columns)])
    elif name in ("ROW_MISSING", "NEVER_EVALUATED"):
        at = rows.index[(rows["role"] == "scored") & rows["base"].isin([f"o{k}" for k in range(5)])][0]
        rows = rows.drop(at)
    elif name == "EVALUATED_TWICE":
        at = rows.index[(rows["role"] == "scored") & (rows["base"] == "o0")][0]
        rows = pd.concat([rows, rows.loc[[at]].assign(base="o1")])
    else:
        raise AssertionError(name)
    return c, m, f, rows


def test_a_sound_cohort_keeps_every_invariant(spark, cohort):
    kept = violations(spark, *cohort)
    assert len(kept) == 27 and not any(kept.values())


def test_every_invariant_can_be_broken(spark, cohort):
    names = [*violations(spark, *cohort)]
    for batch in (names[k::5] for k in range(5)):  # several faults at once: each must be told
        tables = cohort
        for name in batch:
            tables = broken(name, *tables)
        found = violations(spark, *tables)
        assert all(found[name] > 0 for name in batch), (batch, found)
