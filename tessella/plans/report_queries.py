"""Registered queries of reports, seals and the remaining fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import arrays
from tessella.operators import alternating, boosting, features, inference, items, latent, report, structure
from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.plans.fixture_sql import with_obs
from tessella.plans.model_queries import _matrix, _nested, _table
from tessella.plans.relational_queries import CAND
from tessella.sources import adapters
from tessella.sources.adapters import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _obs(spark, sf):
    return items.valid_observations(adapters.responses_from_lineitem(spark, sf))


@query("trajectory", f"""SELECT {sql_shown('event_type, count(*) AS n, count(*) FILTER (value > prev) AS increases', 'arg_min(value, i) AS first; arg_max(value, i) AS last; covar_pop(value, i) FILTER (i > m - 100) / var_pop(i) FILTER (i > m - 100) AS trend', 6)} FROM (
        SELECT event_type, value, lag(value) OVER w AS prev, (row_number() OVER w)::DOUBLE AS i, count(*) OVER (PARTITION BY event_type) AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) GROUP BY event_type""")
def trajectory(spark, sf):
    return shown(report.trajectory(table(spark, sf, "events"), ["event_type"], "event_id", "value"), 6)


@query("trait_variants", f"""SELECT {sql_shown('', 'corr(c_acctbal, k) AS raw; corr(least(c_acctbal, a), least(k, b)) AS winsor; corr(CASE WHEN c_acctbal <= a THEN c_acctbal END, CASE WHEN k <= b THEN k END) AS "drop"', 7)} FROM (
        SELECT *, quantile_cont(c_acctbal, 0.99) OVER () AS a, quantile_cont(k, 0.99) OVER () AS b FROM (SELECT c_custkey, any_value(c_acctbal) AS c_acctbal, sum(o_totalprice) AS k FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1))""")
def trait_variants(spark, sf):
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("k"))
    return shown(report.trait_variants(table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(spent, "c_custkey"), "c_acctbal", "k"), 7)


@query("quartiles_twice", f"SELECT {sql_shown('event_type', 'median(a) AS q1; median(b) AS q2; median(c) AS q3', 6)} FROM (SELECT event_type, user_id % 10 AS u, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events GROUP BY ALL) GROUP BY event_type")
def quartiles_twice(spark, sf):
    return shown(report.quartiles_twice(table(spark, sf, "events").withColumn("u", F.col("user_id") % 10), ["event_type"], ["u"], "value"), 6)


@query("manifest_problems", "SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'NOT_LISTED' END, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 = 0 THEN 'P_SIZE_DIFFERS' END], lambda x: x IS NOT NULL)) AS problem FROM part")
def manifest_problems(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    listed = part.where("p_partkey % 7 <> 0").withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0))
    return report.manifest_problems(part, listed, ["p_partkey"], ["p_size", "p_brand"])


@query("frozen_subset", with_obs(f"SELECT {sql_shown('model_id, place', 'acc')} FROM (SELECT model_id, row_number() OVER (ORDER BY model_id DESC) - 1 AS place FROM acc WHERE model_id::INT % 3 = 0) JOIN acc USING (model_id)", CAND))
def frozen_subset(spark, sf):
    from pyspark.sql import Window

    acc = _obs(spark, sf).groupBy("model_id").agg(F.avg(F.col("y").cast("double")).alias("acc")).withColumn("_row", F.lit(1))
    listed = acc.where(F.col("model_id").cast("int") % 3 == 0).select("model_id", (F.row_number().over(Window.orderBy(F.col("model_id").desc())) - 1).cast("long").alias("place"))
    return shown(report.frozen_subset(acc, listed, "model_id"))


@query("report_lines", "SELECT event_type, '| ' || concat_ws(' | ', event_type, count(*)::VARCHAR, printf('%.3f', max(value))) || ' |' AS line FROM events GROUP BY event_type")
def report_lines(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("m"))
    return g.select("event_type", report.report_line(F.col("event_type"), F.col("n").cast("string"), report.fixed(F.col("m"), 3)).alias("line"))


@query("sigmoids", f"SELECT {sql_shown('event_id', '1 / (1 + exp(-(value - 10))) AS p; 1 / (1 + exp(-greatest(-2::DOUBLE, least(2::DOUBLE, value - 10)))) AS clipped; ln(1 / (1 + exp(-(value - 10) / 10))) AS log_p')} FROM events")
def sigmoids(spark, sf):
    x = F.col("value") - 10
    return shown(table(spark, sf, "events").select("event_id", arrays.sigmoid(x).alias("p"), arrays.sigmoid(x, 2.0).alias("clipped"), arrays.log_sigmoid(x / 10).alias("log_p")))


@query("seal_check", with_obs("SELECT DISTINCT org_id FROM obs WHERE model_id::INT % 25 = 4"))
def seal_check(spark, sf):
    """Organisations in which one prediction was changed after sealing."""
    acc = _obs(spark, sf).groupBy("org_id", "model_id").agg(F.round(F.avg("brier"), 9).alias("pred"))
    later = acc.withColumn("pred", F.col("pred") + F.when(F.col("model_id").cast("int") % 25 == 4, 1e-6).otherwise(0.0))
    return report.broken_seals(report.seal(acc, ["org_id"]), report.seal(later, ["org_id"]), ["org_id"])


@query("endpoint_verdicts")
def endpoint_verdicts(spark, sf):
    _, (preds, _) = _nested(spark, sf)
    preds, key = structure.checkpointed(preds), ["package", "target"]
    diffs = inference.loss_differences(inference.group_losses(preds, key), ["target"])
    folds = inference.loss_differences(inference.group_losses(preds, [*key, "outer"]), ["target", "outer"]).groupBy(*key, "outer").agg(F.avg("d").alias("delta"))
    rows = inference.simultaneous(diffs, key, folds, n_boot=200)
    both = rows.groupBy("package").agg(F.max(F.when(F.col("target") == "y_cal", F.col("status"))).alias("cal"), F.max(F.when(F.col("target") == "y_sel", F.col("status"))).alias("sel"))
    return both.withColumn("verdict", inference.verdict(F.col("cal"), F.col("sel")))


@query("boosted_trees")
def boosted_trees(spark, sf):
    """Histogram boosting on the summaries: every fold predicted by all eight configurations, organisation-weighted."""
    table = _table(spark, sf)
    outer = structure.contexts(table).where("inner IS NULL").select("context", "org_id", "role")
    rows = table.join(F.broadcast(outer), "org_id")
    train = features.group_weights(rows.where("role = 'reference'"), ["context"])
    rows = train.unionByName(rows.where("role = 'scored'").withColumn("v", F.lit(None).cast("double")))
    preds = boosting.fit_and_predict(rows, ["context"], {"summaries": features.SUMMARIES}, ["y_sel"])
    return shown(preds.join(table.select("model_id", F.col("y_sel").alias("truth")), "model_id").select("model_id", "context", "config", "truth", "pred"))


@query("two_parameter_logistic")
def two_parameter_logistic(spark, sf):
    """The correctness channel alone."""
    cell = _matrix(spark, sf).select("model_id", "item_id", F.col("bin").alias("c"), F.lit(None).cast("double").alias("y"), "tok_len")
    models, _, _ = latent.fit_joint(cell, epochs=15)
    return shown(spark.createDataFrame(models).select("model_id", "theta_A"), 6)


@query("beta_channel")
def beta_channel(spark, sf):
    """The response channel alone."""
    cell = _matrix(spark, sf).select("model_id", "item_id", F.lit(None).cast("double").alias("c"), F.col("resp").alias("y"), "tok_len")
    models, _, _ = latent.fit_joint(cell, epochs=15)
    return shown(spark.createDataFrame(models).select("model_id", "theta_A", "theta_C"), 6)


def _alternating(spark, sf, channel: str, kind: str):
    models, _, history = alternating.fit(_matrix(spark, sf).select("model_id", "item_id", F.col(channel).alias("y")), kind)
    schema = "model_id string, theta double, first_loss double, last_loss double"
    return shown(spark.createDataFrame(models.assign(first_loss=history[0] if history else None, last_loss=history[-1] if history else None), schema), 6)


@query("alternating_binary")
def alternating_binary(spark, sf):
    """Traits from correctness alone, all 50 epochs of 100 steps a half."""
    return _alternating(spark, sf, "bin", "binary")


@query("alternating_beta")
def alternating_beta(spark, sf):
    """Traits from response probabilities alone, all 50 epochs of 100 steps a half."""
    return _alternating(spark, sf, "resp", "beta")
