"""Registered queries over single responses and per-model descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import descriptors as d
from tessella.operators import items
from tessella.plans.fixture_sql import HALVES, with_obs
from tessella.sources import adapters

DIGITS = 8


def shown(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison, without negative zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def sql_shown(keys: str, values: str, digits: int = DIGITS) -> str:
    """The same in SQL: names, and 'expression AS name' or plain names separated by '; '."""
    out = []
    for v in values.split("; "):
        expr, _, name = v.rpartition(" AS ")
        out.append(f"round({expr or name}, {digits}) + 0.0::DOUBLE AS {name}")
    return ", ".join([keys, *out] if keys else out)


def _obs(spark, sf):
    return items.valid_observations(adapters.responses_from_lineitem(spark, sf))


QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


BINNED = """bins AS (SELECT model_id, least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS mc, avg(y::INT) AS my FROM obs GROUP BY ALL),
    weighed AS (SELECT *, n / sum(n) OVER (PARTITION BY model_id) AS w FROM bins)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY c DESC, item_id) AS rn, count(*) OVER (PARTITION BY model_id) AS n, avg(e) OVER (PARTITION BY model_id ORDER BY c DESC, item_id ROWS UNBOUNDED PRECEDING) AS run FROM obs)"


@query("model_summary", with_obs(f"SELECT {sql_shown('model_id, a.n', 'acc; conf; over; rel10; r50')} FROM (SELECT model_id, count(*) AS n, avg(y::INT) AS acc, avg(c) AS conf, avg(c) - avg(y::INT) AS over FROM obs GROUP BY 1) a JOIN (SELECT model_id, sum(w * (mc - my) * (mc - my)) AS rel10 FROM weighed GROUP BY 1) USING (model_id) JOIN (SELECT model_id, avg(e) FILTER (rn <= (n + 1) // 2) AS r50 FROM ranked GROUP BY 1) USING (model_id)", BINNED, RANKED))
def model_summary(spark, sf):
    rows = d.in_confidence_order(_obs(spark, sf).select("model_id", "item_id", "c", "y", "e"), ["model_id"])
    out = d.one_pass(rows, ["model_id"], {"r50": F.when(d.half_coverage(), F.col("e")).otherwise(0.0)})
    n = F.col("n")
    out = out.select("model_id", "n", (F.col("y") / n).alias("acc"), (F.col("c") / n).alias("conf"), ((F.col("c") - F.col("y")) / n).alias("over"), "rel10", (F.col("r50") / F.floor((n + 1) / 2)).alias("r50"))
    return shown(out)


@query("item_projection", with_obs(f"SELECT {sql_shown('model_id, item_id, y', 'ell; c; e; z; nll; depth; hn; brier; h; margin', 7)} FROM obs"))
def item_projection(spark, sf):
    return shown(_obs(spark, sf).drop("org_id"), 7)


DEFECTS = """def AS (SELECT *, item_id::INT AS i,
        CASE WHEN item_id::INT % 17 = 0 THEN 0.0::DOUBLE WHEN item_id::INT % 19 = 0 THEN NULL ELSE h1 END AS d1,
        CASE WHEN item_id::INT % 23 = 0 THEN NULL ELSE l1 END AS m1,
        CASE WHEN item_id::INT % 29 = 0 THEN 1.5::DOUBLE WHEN item_id::INT % 31 = 0 THEN 7.0::DOUBLE ELSE gold::DOUBLE END AS g,
        CASE WHEN item_id::INT % 13 = 0 THEN 4 ELSE 3 END AS k FROM resp),
    judged AS (SELECT *, (d1 IS NOT NULL AND d1 > 0)::INT + 2 AS nreal FROM def),
    reasons AS (SELECT model_id, item_id, unnest(list_filter([
        CASE WHEN d1 IS NOT NULL AND NOT d1 > 0 THEN 'bad_char_length' END,
        CASE WHEN d1 IS NULL AND m1 IS NOT NULL THEN 'padding_has_loglik' END,
        CASE WHEN d1 > 0 AND m1 IS NULL THEN 'incomplete_real_loglik' END,
        CASE WHEN g <> floor(g) OR g > 2 OR (g = 0 AND NOT coalesce(d1 > 0, false)) THEN 'invalid_gold' END,
        CASE WHEN nreal < 2 THEN 'fewer_than_two_options' END,
        CASE WHEN k <> nreal THEN 'n_options_disagrees' END], lambda x: x IS NOT NULL)) AS reason FROM judged)"""


@query("validity_reasons", with_obs("SELECT reason, count(*) AS n FROM reasons GROUP BY reason", DEFECTS))
def validity_reasons(spark, sf):
    return items.reason_counts(items.validity(adapters.defective_responses(spark, sf)))


@query("validity_filter", with_obs("SELECT model_id, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM reasons r WHERE r.model_id = j.model_id AND r.item_id = j.item_id)) AS n_valid FROM judged j GROUP BY model_id", DEFECTS))
def validity_filter(spark, sf):
    judged = items.validity(adapters.defective_responses(spark, sf))
    return judged.groupBy("model_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


@query("nonfinite_mask", with_obs("SELECT model_id, count(*) AS n_masked FROM def WHERE NOT coalesce(isfinite(m1), false) OR (k >= 2 AND NOT coalesce(isfinite(l2), false)) OR (k >= 3 AND NOT coalesce(isfinite(l3), false)) GROUP BY model_id", DEFECTS))
def nonfinite_mask(spark, sf):
    rows = adapters.defective_responses(spark, sf)
    return rows.where(items.nonfinite_loglik(rows)).groupBy("model_id").agg(F.count("*").alias("n_masked"))


@query("means", with_obs(f"SELECT {sql_shown('model_id, count(*) AS n', 'avg(y::INT) AS acc; avg(c) AS conf; avg(brier) AS brier; avg(h) AS h; avg(margin) AS margin; avg(c) - avg(y::INT) AS over')} FROM obs GROUP BY model_id"))
def means(spark, sf):
    return shown(d.means(_obs(spark, sf)))


@query("calibration", with_obs(f"SELECT {sql_shown('model_id', 'sum(w * (mc - my) * (mc - my)) AS rel10; sum(w * abs(mc - my)) AS ece10')} FROM weighed GROUP BY model_id", BINNED))
def calibration(spark, sf):
    return shown(d.calibration(_obs(spark, sf)))


_EDGES = BINNED.replace("least(floor(c * 10), 9)", "CASE " + " ".join(f"WHEN c < {j / 10}::DOUBLE THEN {j - 1}" for j in range(1, 10)) + " ELSE 9 END")


@query("calibration_edges", with_obs(f"SELECT {sql_shown('model_id', 'sum(w * (mc - my) * (mc - my)) AS rel10; sum(w * abs(mc - my)) AS ece10')} FROM weighed GROUP BY model_id", _EDGES))
def calibration_edges(spark, sf):
    return shown(d.calibration(_obs(spark, sf), edges=True))


@query("resolution", with_obs(f"SELECT {sql_shown('model_id', 'sum(w * pow(my - acc, 2)) AS a3')} FROM (SELECT *, sum(w * my) OVER (PARTITION BY model_id) AS acc FROM weighed) GROUP BY model_id", BINNED))
def resolution(spark, sf):
    return shown(d.resolution(_obs(spark, sf)))


AUC = "SELECT model_id, {part} CASE WHEN p > 0 AND n > p THEN (r - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)) END AS a1 FROM (SELECT model_id, {part} sum(rk) FILTER (y) AS r, count(*) FILTER (y) AS p, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY model_id {by} ORDER BY c) + (count(*) OVER (PARTITION BY model_id {by}, c) - 1) / 2.0::DOUBLE AS rk FROM {src}) GROUP BY ALL)"


@query("auroc", with_obs(f"SELECT {sql_shown('model_id, CASE WHEN a1 IS NULL THEN \'SINGLE_CLASS\' ELSE \'\' END AS a1_reason', 'a1')} FROM ({AUC.format(part='', by='', src='obs')})"))
def auroc(spark, sf):
    return shown(d.auroc(_obs(spark, sf)))


@query("auroc_single_class", with_obs("SELECT item_id, CASE WHEN max(y::INT) = min(y::INT) THEN 'SINGLE_CLASS' ELSE '' END AS a1_reason FROM obs GROUP BY item_id"))
def auroc_single_class(spark, sf):
    return d.auroc(_obs(spark, sf), ["item_id"]).select("item_id", "a1_reason")


@query("ranked_risk", with_obs(f"SELECT {sql_shown('model_id', 'avg(run) AS a2; avg(e) FILTER (rn <= ceil(0.10::DOUBLE * n)) AS a4; avg(e) FILTER (rn <= ceil(0.25::DOUBLE * n)) AS a5; avg(e) FILTER (rn <= (n + 1) // 2) AS r50; avg(e) AS r100')} FROM ranked GROUP BY model_id", RANKED))
def ranked_risk(spark, sf):
    return shown(d.ranked_risk(_obs(spark, sf)))


@query("error_means", with_obs(f"SELECT {sql_shown('model_id', 'avg(nll) AS b1; avg(e * c) AS b2; avg(e * c * c) AS b3; avg(z) AS b4; avg(depth) AS b6; avg(hn) AS b7')} FROM obs GROUP BY model_id"))
def error_means(spark, sf):
    return shown(d.error_means(_obs(spark, sf)))


TOP = "SELECT model_id, {part} avg(z) AS b5 FROM (SELECT *, row_number() OVER (PARTITION BY model_id {by} ORDER BY z DESC, item_id) AS rn, count(*) OVER (PARTITION BY model_id {by}) AS n FROM {src}) WHERE rn <= ceil(0.10::DOUBLE * n) GROUP BY ALL"


@query("top_loss", with_obs(f"SELECT {sql_shown('model_id', 'b5')} FROM ({TOP.format(part='', by='', src='obs')})"))
def top_loss(spark, sf):
    return shown(d.top_loss(_obs(spark, sf)))


PARTS = HALVES + ", parts AS (SELECT obs.*, unnest(['full', 'half' || half]) AS part FROM obs JOIN halves USING (item_id))"


@query(
    "ab_splits",
    with_obs(
        f"""SELECT {sql_shown('model_id, part', 'a1; a2; a3; a4; a5; b1; b5')} FROM ({AUC.format(part='part,', by=', part', src='parts')})
        JOIN (SELECT model_id, part, avg(run) AS a2, avg(e) FILTER (rn <= ceil(0.10::DOUBLE * n)) AS a4, avg(e) FILTER (rn <= ceil(0.25::DOUBLE * n)) AS a5, avg(nll) AS b1 FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY model_id, part) AS n, avg(e) OVER (PARTITION BY model_id, part ORDER BY c DESC, item_id ROWS UNBOUNDED PRECEDING) AS run FROM parts WINDOW w AS (PARTITION BY model_id, part ORDER BY c DESC, item_id)) GROUP BY ALL) USING (model_id, part)
        JOIN (SELECT model_id, part, sum(n / t * pow(my - acc, 2)) AS a3 FROM (SELECT *, sum(n) OVER (PARTITION BY model_id, part) AS t, sum(n * my) OVER (PARTITION BY model_id, part) / sum(n) OVER (PARTITION BY model_id, part) AS acc FROM (SELECT model_id, part, least(floor(c * 10), 9) AS bin, count(*) AS n, avg(y::INT) AS my FROM parts GROUP BY ALL)) GROUP BY ALL) USING (model_id, part)
        JOIN ({TOP.format(part='part,', by=', part', src='parts')}) USING (model_id, part)""",
        PARTS,
    ),
)
def ab_splits(spark, sf):
    return shown(d.ab_metrics(d.with_splits(_obs(spark, sf)), ["model_id", "part"]).select("model_id", "part", "a1", "a2", "a3", "a4", "a5", "b1", "b5"))


@query("item_halves", with_obs("SELECT item_id, half::INT AS half FROM halves", HALVES))
def item_halves(spark, sf):
    return d.item_halves(_obs(spark, sf)).withColumn("half", F.col("half").cast("int"))


@query("hash_sample", with_obs("SELECT model_id FROM (SELECT DISTINCT model_id FROM obs) ORDER BY sha256('20260914|' || model_id), model_id LIMIT 100"))
def hash_sample(spark, sf):
    ids = _obs(spark, sf).select("model_id").distinct()
    return ids.orderBy(F.sha2(F.concat(F.lit("20260914|"), "model_id"), 256), "model_id").limit(100)


@query("cells", with_obs(f"SELECT {sql_shown('model_id, item_id', 'round(CASE gold WHEN 0 THEN l1 WHEN 1 THEN l2 ELSE l3 END, 6) AS lp_mean; round(CASE gold WHEN 0 THEN l1 WHEN 1 THEN l2 ELSE l3 END, 4) AS lp_sum; (y)::INT::DOUBLE AS bin; round(c, 6) AS conf', 6)} FROM resp JOIN obs USING (model_id, item_id)"))
def cells(spark, sf):
    return shown(items.cells(adapters.responses_from_lineitem(spark, sf)), 6)


@query("slope_inputs", with_obs(f"SELECT {sql_shown('model_id, item_id', 'g - (greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))) AS ell_raw')} FROM (SELECT *, CASE gold WHEN 0 THEN l1 WHEN 1 THEN l2 ELSE l3 END AS g, CASE gold WHEN 0 THEN l2 ELSE l1 END AS a, CASE gold WHEN 2 THEN l2 ELSE l3 END AS b FROM resp)"))
def slope_inputs(spark, sf):
    return shown(items.slope_inputs(adapters.responses_from_lineitem(spark, sf)))


@query("embedding_summary", f"""WITH r AS (SELECT m, vec_id, [x::DOUBLE for x in embedding[4 * m + 1 : 4 * m + 4]] AS u, label % 4 AS gold FROM embeddings, range(16) t(m)),
    p AS (SELECT *, list_max(u) AS t, list_sum([exp(x - list_max(u)) for x in u]) AS s FROM r)
    SELECT {sql_shown("m::VARCHAR AS model_id, count(*) AS n", "avg((list_position(u, t) - 1 = gold)::INT) AS acc; avg(1 / s) AS conf; avg(t - u[gold + 1]) AS z; avg(t + ln(s) - u[gold + 1]) AS nll")} FROM p GROUP BY m""")
def embedding_summary(spark, sf):
    obs = items.valid_observations(adapters.responses_from_embeddings(spark, sf))
    return shown(obs.groupBy("model_id").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("acc"), F.avg("c").alias("conf"), F.avg("z").alias("z"), F.avg("nll").alias("nll")))
