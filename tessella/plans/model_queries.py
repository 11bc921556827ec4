"""Registered queries over features, fits, selection, inference and latent models."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.functions.stats import guarded_corr, spearman
from tessella.operators import descriptors, features as f, inference as inf, items, latent, relational, structure
from tessella.plans.descriptor_queries import BINNED, RANKED, shown, sql_shown
from tessella.plans.fixture_sql import HALVES, observations, responses, with_obs
from tessella.plans.relational_queries import CAND
from tessella.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _obs(spark, sf, target=False, values=None):
    return items.valid_observations(adapters.responses_from_lineitem(spark, sf, target), values)


def _summaries(spark, sf):
    return f.summaries(_obs(spark, sf, values=["c", "y", "e", "brier", "h", "margin"]))


def _targets(spark, sf):
    return f.score_targets(_obs(spark, sf, True, ["c", "y", "e"]))


TARGET = f"{responses('tresp', True)},\n{observations('tobs', 'tresp')}"
SUMMARY = BINNED + ", " + RANKED + """, summary AS (SELECT * FROM (SELECT model_id, any_value(org_id) AS org_id, avg(y::INT) AS acc, avg(c) AS conf, avg(c) - avg(y::INT) AS over, avg(brier) AS brier, avg(h) AS h, avg(margin) AS margin FROM obs GROUP BY 1)
        JOIN (SELECT model_id, sum(w * (mc - my) * (mc - my)) AS rel10, sum(w * abs(mc - my)) AS ece10 FROM weighed GROUP BY 1) USING (model_id) JOIN (SELECT model_id, avg(e) FILTER (rn <= (n + 1) // 2) AS r50 FROM ranked GROUP BY 1) USING (model_id))"""
SEL = TARGET + ", targets AS (SELECT model_id, avg(e) FILTER (rn <= (n + 1) // 2) AS y_sel FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY c DESC, item_id) AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM tobs) GROUP BY 1), ft AS (SELECT * FROM summary JOIN targets USING (model_id))"


@query("feature_table", with_obs(f"SELECT {sql_shown('model_id, org_id', 'acc; conf; over; rel10; r50; ece10; brier; h; margin')} FROM summary", SUMMARY))
def feature_table(spark, sf):
    return shown(f.summaries(_obs(spark, sf)))


def _table(spark, sf, summaries=None, targets=None):
    """Summaries and targets of each model that has both, from one pass; or what the query has already, with the other made here."""
    if summaries is None and targets is None:
        return structure.checkpointed(f.model_table(adapters.lines_by_model(spark, sf), adapters.responses_of_both))
    summaries, targets = summaries or _summaries(spark, sf), targets or _targets(spark, sf)
    return structure.checkpointed(summaries.join(targets.drop("n_valid", "k_selected"), ["model_id", "org_id"]))


@query("group_weights", with_obs(f"SELECT {sql_shown('model_id', '1.0::DOUBLE / ((SELECT count(DISTINCT org_id) FROM summary) * count(*) OVER (PARTITION BY org_id)) AS v')} FROM summary", SUMMARY))
def group_weights(spark, sf):
    return shown(f.group_weights(f.summaries(_obs(spark, sf)), []).select("model_id", "v"))


@query("imputed", with_obs(f"SELECT {sql_shown('model_id', 'coalesce(CASE WHEN model_id::INT % 4 <> 0 THEN acc END, median(CASE WHEN model_id::INT % 4 <> 0 THEN acc END) OVER ()) AS acc; 0.0::DOUBLE AS conf')} FROM summary", SUMMARY))
def imputed(spark, sf):
    rows = f.summaries(_obs(spark, sf)).select(F.lit("all").alias("k"), "model_id", F.when(F.col("model_id").cast("int") % 4 != 0, F.col("acc")).alias("acc"), F.lit(None).cast("double").alias("conf"))
    return shown(f.impute(rows, f.medians(rows, ["k"], ["acc", "conf"]), ["k"], ["acc", "conf"]).drop("k"))


RIDGE = """w AS (SELECT *, 1.0::DOUBLE / ((SELECT count(DISTINCT org_id) FROM ft) * count(*) OVER (PARTITION BY org_id)) AS v FROM ft),
    mom AS (SELECT sum(v * acc) AS mx, sum(v * y_sel) AS my, sum(v * acc * acc) - sum(v * acc) * sum(v * acc) AS vx, sum(v * acc * y_sel) - sum(v * acc) * sum(v * y_sel) AS cxy FROM w),
    ridge AS (SELECT model_id, org_id, y_sel AS truth, lam, greatest(0.0::DOUBLE, least(1.0::DOUBLE, my + (cxy / sqrt(vx)) / (1 + lam) * (acc - mx) / sqrt(vx))) AS pred FROM w, mom, (SELECT unnest([0.01::DOUBLE, 1.0::DOUBLE, 100.0::DOUBLE]) AS lam))"""


def _ridge(spark, sf, summaries=None, targets=None):
    rows = f.group_weights(_table(spark, sf, summaries, targets), [])
    base = {"base": ["acc"]}
    fits = f.ridge_fits(rows, [], base, ["y_sel"], [0.01, 1.0, 100.0])
    return f.predict(rows.select("model_id", "org_id", "acc", F.col("y_sel").alias("truth")), fits, [], base)


@query("ridge_one_feature", with_obs(f"SELECT {sql_shown('model_id, lam', 'truth; pred')} FROM ridge", SUMMARY, SEL, RIDGE))
def ridge_one_feature(spark, sf):
    return shown(_ridge(spark, sf).select("model_id", "lam", "truth", "pred"))


TWO = """w AS (SELECT *, 1.0::DOUBLE / ((SELECT count(DISTINCT org_id) FROM ft) * count(*) OVER (PARTITION BY org_id)) AS v FROM ft),
    mom AS (SELECT sum(v * acc) AS m1, sum(v * conf) AS m2, sum(v * y_sel) AS my, sqrt(sum(v * acc * acc) - sum(v * acc) * sum(v * acc)) AS s1, sqrt(sum(v * conf * conf) - sum(v * conf) * sum(v * conf)) AS s2,
        sum(v * acc * conf) - sum(v * acc) * sum(v * conf) AS c12, sum(v * acc * y_sel) - sum(v * acc) * sum(v * y_sel) AS c1y, sum(v * conf * y_sel) - sum(v * conf) * sum(v * y_sel) AS c2y FROM w),
    std AS (SELECT *, c12 / (s1 * s2) AS r, c1y / s1 AS a, c2y / s2 AS b FROM mom),
    ridge AS (SELECT model_id, lam, y_sel AS truth, greatest(0.0::DOUBLE, least(1.0::DOUBLE, my + ((1 + lam) * a - r * b) / ((1 + lam) * (1 + lam) - r * r) * (acc - m1) / s1 + ((1 + lam) * b - r * a) / ((1 + lam) * (1 + lam) - r * r) * (conf - m2) / s2)) AS pred
        FROM w, std, (SELECT unnest([0.01::DOUBLE, 1.0::DOUBLE, 100.0::DOUBLE]) AS lam))"""


@query("ridge_two_features", with_obs(f"SELECT {sql_shown('model_id, lam', 'truth; pred')} FROM ridge", SUMMARY, SEL, TWO))
def ridge_two_features(spark, sf):
    """Two features and one of no spread, which gets no coefficient."""
    rows = f.group_weights(_table(spark, sf), []).withColumn("flat", F.lit(3.0))
    three = {"pair": ["acc", "conf", "flat"]}
    fits = f.ridge_fits(rows, [], three, ["y_sel"], [0.01, 1.0, 100.0])
    preds = f.predict(rows.select("model_id", "org_id", "acc", "conf", "flat", F.col("y_sel").alias("truth")), fits, [], three)
    return shown(preds.select("model_id", "lam", "truth", "pred"))


BOTH = RIDGE + ", " + re.sub(r"\b(w|mom|ridge)\b", r"\g<1>_two", TWO) + """, errors AS (SELECT 'base' AS package, 0 AS place, org_id, pow(truth - pred, 2) AS e FROM ridge WHERE lam = 0.01
    UNION ALL SELECT 'pair', 1, org_id, pow(truth - pred, 2) FROM ridge_two JOIN (SELECT model_id, org_id FROM ft) USING (model_id) WHERE lam = 0.01),
    by_package AS (SELECT package, place, avg(m) AS loss FROM (SELECT package, place, org_id, avg(e) AS m FROM errors GROUP BY ALL) GROUP BY ALL)"""


@query("select_package", with_obs("SELECT package FROM by_package WHERE loss <= (SELECT min(loss) FROM by_package) + 1e-12 ORDER BY place LIMIT 1", SUMMARY, SEL, BOTH))
def select_package(spark, sf):
    rows = f.group_weights(_table(spark, sf), [])
    packages = {"base": ["acc"], "pair": ["acc", "conf"]}
    fits = f.ridge_fits(rows, [], packages, ["y_sel"], [0.01])
    preds = f.predict(rows.select("model_id", "org_id", "acc", "conf", F.col("y_sel").alias("truth")), fits, [], packages)
    losses = f.group_mse(preds, ["package"]).withColumn("k", F.lit(0))
    return f.select_package(losses, ["k"], list(packages)).select("package")


LOSS = RIDGE + ", loss AS (SELECT lam, avg(m) AS loss FROM (SELECT lam, org_id, avg(pow(truth - pred, 2)) AS m FROM ridge GROUP BY ALL) GROUP BY lam)"


@query("group_mse", with_obs(f"SELECT {sql_shown('lam', 'loss', 10)} FROM loss", SUMMARY, SEL, LOSS))
def group_mse(spark, sf):
    return shown(f.group_mse(_ridge(spark, sf), ["lam"]).select("lam", "loss"), 10)


@query("select_configuration", with_obs("SELECT lam FROM loss WHERE loss <= (SELECT min(loss) FROM loss) + 1e-12 ORDER BY lam DESC LIMIT 1", SUMMARY, SEL, LOSS))
def select_configuration(spark, sf):
    losses = f.group_mse(_ridge(spark, sf), ["lam"]).withColumn("k", F.lit(0))
    return f.select_configuration(losses, ["k"]).select("lam")


@query("linear_baseline", with_obs(f"SELECT {sql_shown('org_id', 'CASE WHEN var_pop(acc) > 1e-12 THEN covar_pop(acc, y_sel) / var_pop(acc) END AS slope; avg(y_sel) - CASE WHEN var_pop(acc) > 1e-12 THEN covar_pop(acc, y_sel) / var_pop(acc) END * avg(acc) AS intercept', 6)} FROM ft GROUP BY org_id", SUMMARY, SEL))
def linear_baseline(spark, sf):
    return shown(f.linear_baseline(_table(spark, sf), ["org_id"], "acc", "y_sel"), 6)


def _nested(spark, sf):
    table = _table(spark, sf)
    return table, f.nested_validation(table, structure.contexts(table))


@query("nested_validation")
def nested_validation(spark, sf):
    return shown(_nested(spark, sf)[1][0])


@query("chosen_penalties")
def chosen_penalties(spark, sf):
    return shown(_nested(spark, sf)[1][1])


@query("simultaneous_intervals")
def simultaneous_intervals(spark, sf):
    _, (preds, _) = _nested(spark, sf)
    preds = structure.checkpointed(preds)
    key = ["package", "target"]
    diffs = inf.loss_differences(inf.group_losses(preds, key), ["target"])
    per_fold = inf.loss_differences(inf.group_losses(preds, [*key, "outer"]), ["target", "outer"]).groupBy(*key, "outer").agg(F.avg("d").alias("delta"))
    return shown(inf.simultaneous(diffs, key, per_fold))


@query("descriptive_intervals")
def descriptive_intervals(spark, sf):
    per_org = f.summaries(_obs(spark, sf)).groupBy("org_id").agg(F.avg("acc").alias("acc"))
    return shown(inf.percentile_interval(inf.bootstrap_means(per_org.withColumn("metric", F.lit("acc")), ["metric"], "acc"), ["metric"]))


@query("cluster_r2")
def cluster_r2(spark, sf):
    best = _ridge(spark, sf).where("lam = 0.01")
    return shown(inf.percentile_interval(inf.cluster_r2(best, "truth", "pred").select(F.lit("r2").alias("metric"), F.col("r2").alias("m")), ["metric"]))


@query("predictions_with_truth", with_obs(f"SELECT {sql_shown('model_id, org_id, lam', 'truth AS y_sel; pred')} FROM ridge", SUMMARY, SEL, RIDGE))
def predictions_with_truth(spark, sf):
    targets = structure.checkpointed(_targets(spark, sf))  # read twice
    preds = _ridge(spark, sf, targets=targets).select("model_id", "org_id", "lam", "pred")
    return shown(relational.with_truth(preds, targets.select("model_id", "org_id", "y_sel")))


@query("selection_study", with_obs(f"SELECT {sql_shown('org_id', 'chosen; oracle; chosen - oracle AS regret')} FROM (SELECT org_id, arg_min(truth, pred) AS chosen, min(truth) AS oracle FROM ridge JOIN cand USING (model_id, org_id) WHERE lam = 1 GROUP BY org_id)", SUMMARY, SEL, LOSS, CAND))
def selection_study(spark, sf):
    summaries = structure.checkpointed(_summaries(spark, sf))  # read twice
    preds = _ridge(spark, sf, summaries).where("lam = 1").withColumn("k", F.lit(0))
    return shown(inf.selection_study(relational.candidates(summaries.select("model_id", "org_id", "acc")), preds, ["k"]).drop("k"))


JACK = "fam AS (SELECT *, model_id::INT % 6 AS family FROM ft)"


@query("jackknife", with_obs(f"""SELECT {sql_shown('n_families', 'point; mean; lo AS "min"; hi AS "max"; se; point - 1.96 * se AS low; point + 1.96 * se AS high')} FROM (SELECT (SELECT corr(acc, y_sel) FROM fam) AS point, count(*) AS n_families, avg(v) AS mean, min(v) AS lo, max(v) AS hi, sqrt((count(*) - 1) * var_pop(v)) AS se
        FROM (SELECT k, corr(acc, y_sel) AS v FROM fam, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE family <> k GROUP BY k HAVING count(*) >= 10))""", SUMMARY, SEL, JACK))
def jackknife(spark, sf):
    rows = _table(spark, sf).withColumn("family", F.col("model_id").cast("int") % 6)
    return shown(inf.jackknife_corr(rows, rows.select("family").where("family < 5"), "acc", "y_sel"))


@query("permutation_null")
def permutation_null(spark, sf):
    return shown(inf.permutation_null(_table(spark, sf), "acc", "y_sel", "model_id"))


@query("risk_bounds", with_obs(f"SELECT {sql_shown('model_id', 'greatest(0, e - (n - k)) / k AS low; least(e, k) / k AS high; r50 AS risk')} FROM (SELECT model_id, sum(e)::BIGINT AS e, count(*) AS n, (count(*) + 1) // 2 AS k FROM obs GROUP BY 1) JOIN summary USING (model_id)", SUMMARY))
def risk_bounds(spark, sf):
    obs = _obs(spark, sf)
    g = obs.groupBy("model_id").agg(F.sum("e").cast("long").alias("e"), F.count("*").alias("n")).withColumn("k", F.floor((F.col("n") + 1) / 2))
    low, high = inf.risk_bounds(F.col("e"), F.col("n"), F.col("k"))
    return shown(g.select("model_id", low.alias("low"), high.alias("high")).join(descriptors.ranked_risk(obs).select("model_id", F.col("r50").alias("risk")), "model_id"))


@query("half_stability", with_obs(f"""SELECT {sql_shown("'conf' AS metric", 'corr(x, y) AS rho', 7)} FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y
        FROM (SELECT model_id, avg(c) FILTER (half = 0) AS a, avg(c) FILTER (half = 1) AS b FROM obs JOIN halves USING (item_id) GROUP BY 1))""", HALVES))
def half_stability(spark, sf):
    obs = _obs(spark, sf)
    both = obs.join(descriptors.item_halves(obs), "item_id").groupBy("model_id").agg(F.avg(F.when(F.col("half") == 0, F.col("c"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("c"))).alias("b"))
    return shown(spearman(both.withColumn("metric", F.lit("conf")), ["metric"], "a", "b"), 7)


@query("metric_correlations", with_obs(f"SELECT {sql_shown('count(*) AS n', 'corr(acc, conf) AS acc_conf; corr(acc, rel10) AS acc_rel10; corr(brier, r50) AS brier_r50', 7)} FROM summary", SUMMARY))
def metric_correlations(spark, sf):
    s = f.summaries(_obs(spark, sf))
    return shown(s.agg(F.count("*").alias("n"), guarded_corr("acc", "conf").alias("acc_conf"), guarded_corr("acc", "rel10").alias("acc_rel10"), guarded_corr("brier", "r50").alias("brier_r50")), 7)


def _matrix(spark, sf, target=False):
    rows = adapters.responses_from_lineitem(spark, sf, target)
    return items.with_response_inputs(items.cells(rows))


@query("response_inputs", with_obs(f"SELECT {sql_shown('model_id, item_id', 'least(greatest(exp(round(g, 6)), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS resp', 6)} FROM (SELECT model_id, item_id, CASE gold WHEN 0 THEN l1 WHEN 1 THEN l2 ELSE l3 END AS g FROM resp)"))
def response_inputs(spark, sf):
    return shown(_matrix(spark, sf).select("model_id", "item_id", "resp"), 6)


def _model_means(spark, sf, target=False):
    return _matrix(spark, sf, target).groupBy("model_id").agg(F.avg("bin").alias("acc"), F.avg("conf").alias("conf"), F.avg("resp").alias("resp"), F.avg(F.abs("lp_sum")).alias("tok_len"))


@query("model_means", with_obs(f"SELECT {sql_shown('model_id', 'avg(y::INT) AS acc; avg(round(c, 6)) AS conf', 6)} FROM obs GROUP BY model_id"))
def model_means(spark, sf):
    return shown(_model_means(spark, sf).select("model_id", "acc", "conf"), 6)


@query("residual_ladder")
def residual_ladder(spark, sf):
    a, b = (structure.checkpointed(_model_means(spark, sf, t)) for t in (False, True))
    return shown(latent.ladder(a, b, "resp"))


@query("sign_alignment", with_obs(f"SELECT {sql_shown('model_id', '-over * CASE WHEN (SELECT corr(-over, acc) FROM summary) < 0 THEN -1 ELSE 1 END AS value')} FROM summary", SUMMARY))
def sign_alignment(spark, sf):
    rows = f.summaries(_obs(spark, sf)).select("model_id", (-F.col("over")).alias("value"), "acc")
    return shown(latent.align_sign(rows, "value", "acc").select("model_id", "value"))


def _joint(spark, sf, epochs):
    cell = _matrix(spark, sf).select("model_id", "item_id", F.col("bin").alias("c"), F.col("resp").alias("y"), "tok_len")
    return cell, latent.fit_joint(cell, epochs=epochs)


@query("joint_model")
def joint_model(spark, sf):
    _, (models, _, history) = _joint(spark, sf, 25)
    models["falls"] = history[-1] < history[0]
    return shown(spark.createDataFrame(models), 6)


@query("gauge_check")
def gauge_check(spark, sf):
    cell, (models, item_rows, _) = _joint(spark, sf, 5)
    return shown(latent.gauge_check(cell, spark.createDataFrame(models), spark.createDataFrame(item_rows)), 6)


@query("transfer_traits")
def transfer_traits(spark, sf):
    obs = _obs(spark, sf)
    positions = structure.initial_positions(obs.withColumn("all", F.lit(0)), ["all"]).where("b IS NOT NULL")
    models = structure.line_fit(obs.join(positions.drop("all"), "item_id"), ["model_id"]).join(f.summaries(obs).select("model_id", "acc"), "model_id")
    return shown(latent.transfer(models.where("s > 0"), positions), 6)
