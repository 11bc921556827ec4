"""Registered queries over reference populations, fits and residual shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import crossfit, descriptors, items, structure
from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.plans.fixture_sql import HALVES, with_obs
from tessella.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _obs(spark, sf, values=None):
    return items.valid_observations(adapters.responses_from_lineitem(spark, sf), values)


FOLDS = "folds AS (SELECT org_id, (row_number() OVER (ORDER BY sha256('20260914|' || org_id), org_id) - 1) % 5 AS fold FROM (SELECT DISTINCT org_id FROM obs))"
MEMBERS = FOLDS + ", members AS (SELECT 'o' || k AS context, k, org_id, CASE WHEN fold = k THEN 'scored' ELSE 'reference' END AS role FROM folds, range(5) t(k))"
NESTED = MEMBERS + """, inner_folds AS (SELECT k, org_id, (row_number() OVER (PARTITION BY k ORDER BY sha256('20260914|inner|' || org_id), org_id) - 1) % 4 AS f FROM members WHERE role = 'reference'),
    all_members AS (SELECT context, k AS outer_fold, NULL::INT AS inner_fold, org_id, role FROM members
        UNION ALL SELECT 'o' || k || 'i' || j, k, j, org_id, CASE WHEN f = j THEN 'scored' ELSE 'reference' END FROM inner_folds, range(4) t(j))"""


@query("org_folds", with_obs("SELECT org_id, fold::INT AS fold FROM folds", FOLDS))
def org_folds(spark, sf):
    return structure.folds(_obs(spark, sf), 5)


@query("contexts", with_obs("SELECT a.context, outer_fold::INT AS outer_fold, coalesce(inner_fold, -1)::INT AS inner_fold, org_id, role, ref_key FROM all_members a JOIN (SELECT context, sha256(string_agg(org_id, chr(10) ORDER BY org_id)) AS ref_key FROM all_members WHERE role = 'reference' GROUP BY 1) USING (context)", NESTED))
def contexts(spark, sf):
    return structure.contexts(_obs(spark, sf)).select("context", F.col("outer").cast("int").alias("outer_fold"), F.coalesce("inner", F.lit(-1)).cast("int").alias("inner_fold"), "org_id", "role", "ref_key")


@query("reference_sets", with_obs("SELECT ref_key, count(*) AS n_contexts FROM (SELECT context, sha256(string_agg(org_id, chr(10) ORDER BY org_id)) AS ref_key FROM all_members WHERE role = 'reference' GROUP BY 1) GROUP BY 1", NESTED))
def reference_sets(spark, sf):
    return structure.contexts(_obs(spark, sf)).select("context", "ref_key").distinct().groupBy("ref_key").agg(F.count("*").alias("n_contexts"))


def _outer(spark, sf, obs):
    return structure.contexts(obs).where("inner IS NULL")


EASE = MEMBERS + """, per_org AS (SELECT context, item_id, org_id, sum(e) AS k, count(*) AS n FROM obs JOIN members USING (org_id) WHERE role = 'reference' GROUP BY ALL),
    ease AS (SELECT context, item_id, CASE WHEN sum(n) >= 20 THEN 1 - avg((k + 0.5::DOUBLE) / (n + 1)) END AS w, sum(n)::BIGINT AS n_ref, count(*) AS n_ref_orgs FROM per_org GROUP BY ALL)"""


@query("reference_ease", with_obs(f"SELECT {sql_shown('context, item_id, n_ref, n_ref_orgs', 'w')} FROM ease", EASE))
def reference_ease(spark, sf):
    obs = _obs(spark, sf)
    members = _outer(spark, sf, obs).where("role = 'reference'").select(F.col("context").alias("ref_key"), "org_id")
    return shown(structure.reference_ease(obs, members).withColumnRenamed("ref_key", "context"))


@query("c_metrics", with_obs(f"""SELECT {sql_shown('context, model_id', 'c1; c2; c3; c4')} FROM (
        SELECT context, model_id, any_value(a1) AS c1, any_value(a2) AS c2, any_value(a3) AS c3, CASE WHEN any_value(n) >= 4 THEN sum(m / n * pow(g - mean, 2)) END AS c4 FROM (
            SELECT context, model_id, bin, count(*) AS m, avg(gap) AS g, any_value(n) AS n, any_value(mean) AS mean, any_value(a1) AS a1, any_value(a2) AS a2, any_value(a3) AS a3 FROM (
                SELECT *, floor(4 * (row_number() OVER (PARTITION BY context, model_id ORDER BY round(w, 12), item_id) - 1) / (count(*) OVER p)) AS bin, count(*) OVER p AS n, avg(gap) OVER p AS mean, avg(w * e) OVER p AS a1, avg(w * e * c) OVER p AS a2, avg(w * z) OVER p AS a3 FROM (
                    SELECT context, model_id, item_id, w, e, c, z, c - y::INT AS gap FROM obs JOIN members USING (org_id) JOIN ease USING (context, item_id) WHERE role = 'scored' AND w IS NOT NULL)
                WINDOW p AS (PARTITION BY context, model_id)) GROUP BY ALL) GROUP BY ALL)""", EASE))
def c_metrics(spark, sf):
    obs = _obs(spark, sf)
    members = _outer(spark, sf, obs).select("context", "org_id", "role")
    ease = structure.reference_ease(obs, members.where("role = 'reference'").select(F.col("context").alias("ref_key"), "org_id")).withColumnRenamed("ref_key", "context")
    scored = obs.join(members.where("role = 'scored'").drop("role"), "org_id")
    return shown(structure.c_metrics(scored, ease.select("context", "item_id", "w"), ["context", "model_id"]))


START = HALVES + """, means AS (SELECT half, item_id, avg(ell) AS m, count(*) AS n FROM obs JOIN halves USING (item_id) GROUP BY ALL),
    pos AS (SELECT half, item_id, (avg(m) OVER (PARTITION BY half) - m) / stddev_pop(m) OVER (PARTITION BY half) AS b FROM means WHERE n >= 20),
    rows AS (SELECT model_id, org_id, half, item_id, ell, b FROM obs JOIN pos USING (item_id)),
    fit AS (SELECT model_id, half, count(*) AS n, CASE WHEN var_pop(b) > 1e-12 THEN -covar_pop(ell, b) / var_pop(b) END AS s, CASE WHEN var_pop(b) > 1e-12 THEN avg(ell) - covar_pop(ell, b) / var_pop(b) * avg(b) END AS a FROM rows GROUP BY ALL)"""


def _rows(spark, sf):
    halved = crossfit.halved(_obs(spark, sf, ["ell"]))  # every branch reads this table
    return halved.join(structure.initial_positions(halved, ["half"]), ["half", "item_id"])


@query("initial_positions", with_obs(f"SELECT {sql_shown('half::INT AS half, item_id', 'b')} FROM pos", START))
def initial_positions(spark, sf):
    obs = _obs(spark, sf)
    halved = obs.join(descriptors.item_halves(obs), "item_id")
    return shown(structure.initial_positions(halved, ["half"]).withColumn("half", F.col("half").cast("int")))


@query("source_projection", with_obs(f"""SELECT {sql_shown("model_id, half::INT AS half, n, reason", "a; s; sigma; CASE WHEN reason = '' THEN a / s END AS theta; CASE WHEN reason = '' THEN ln(s) END AS log_s; CASE WHEN reason = '' THEN ln(sigma) END AS log_sigma")} FROM (
        SELECT model_id, half, f.n, f.a, f.s, sqrt(avg(pow(ell - (f.a - f.s * b), 2))) AS sigma, CASE WHEN f.n < 100 THEN 'EVALUATION_ITEMS_LT100' WHEN f.s <= 1e-8 THEN 'S_LE1E8' ELSE '' END AS reason FROM rows JOIN fit f USING (model_id, half) GROUP BY ALL)""", START))
def source_projection(spark, sf):
    return shown(structure.project_source(_rows(spark, sf), ["model_id", "half"]).withColumn("half", F.col("half").cast("int")))


RES = START + ", res AS (SELECT model_id, half, item_id, b, ell - (a - s * b) AS r FROM rows JOIN fit USING (model_id, half))"


@query("residual_shape", with_obs(f"""SELECT {sql_shown('model_id, half::INT AS half', 'd1; d2; d3; d4')} FROM (
        SELECT model_id, half, sum(pow(least(r, 0), 2)) / sum(r * r) AS d1, kurtosis_pop(r) AS d2, corr(r, b * b) AS d4, corr(x, y) AS d3 FROM (
            SELECT *, rank() OVER (PARTITION BY model_id, half ORDER BY abs(r)) + (count(*) OVER (PARTITION BY model_id, half, abs(r)) - 1) / 2.0::DOUBLE AS x,
                rank() OVER (PARTITION BY model_id, half ORDER BY b) + (count(*) OVER (PARTITION BY model_id, half, b) - 1) / 2.0::DOUBLE AS y FROM res) GROUP BY ALL)""", RES))
def residual_shape(spark, sf):
    rows, by = _rows(spark, sf), ["model_id", "half"]
    return shown(structure.residual_shape(structure.residuals(rows, structure.line_fit(rows, by), by), by).withColumn("half", F.col("half").cast("int")))


@query("reference_items", with_obs(f"SELECT {sql_shown('half::INT AS half, item_id, count(*) AS n_ref', 'CASE WHEN count(*) >= 20 THEN sum(s * (a - ell)) / sum(s * s) END AS b; sum(s * s) AS denom')} FROM rows JOIN fit USING (model_id, half) GROUP BY half, item_id", START))
def reference_items(spark, sf):
    rows = _rows(spark, sf)
    models = structure.line_fit(rows, ["half", "model_id"]).select("half", "model_id", "a", "s")
    return shown(structure.project_reference_items(rows.select("half", "model_id", "item_id", "ell"), models, ["half"]).withColumn("half", F.col("half").cast("int")))


@query("reference_models", with_obs(f"SELECT {sql_shown('half::INT AS half, model_id', 'a; s')} FROM fit", START))
def reference_models(spark, sf):
    return shown(structure.line_fit(_rows(spark, sf), ["half", "model_id"]).select(F.col("half").cast("int").alias("half"), "model_id", "a", "s"))


ROUNDS, TIGHT = 24, 1e-10


def _rounds(n: int) -> str:
    """The alternating fit written out: n rounds of lines, positions, scale and sign, from start positions."""
    out = ["cells AS MATERIALIZED (SELECT half AS direction, model_id, item_id, ell FROM rows)", "b0 AS MATERIALIZED (SELECT half AS direction, item_id, b FROM pos)"]
    for k in range(1, n + 1):
        out += [
            f"l{k} AS MATERIALIZED (SELECT direction, model_id, -covar_pop(ell, b) / var_pop(b) AS s, avg(ell) - covar_pop(ell, b) / var_pop(b) * avg(b) AS a FROM cells JOIN b{k - 1} USING (direction, item_id) GROUP BY ALL)",
            f"r{k} AS MATERIALIZED (SELECT direction, item_id, sum(s * (a - ell)) / sum(s * s) AS raw FROM cells JOIN l{k} USING (direction, model_id) GROUP BY ALL)",
            f"z{k} AS MATERIALIZED (SELECT direction, item_id, (raw - avg(raw) OVER w) / stddev_pop(raw) OVER w AS z FROM r{k} WINDOW w AS (PARTITION BY direction))",
            f"b{k} AS MATERIALIZED (SELECT direction, item_id, z * CASE WHEN sum(z * b) OVER (PARTITION BY direction) < 0 THEN -1 ELSE 1 END AS b FROM z{k} JOIN b0 USING (direction, item_id))",
        ]
    return ", ".join(out)


FITTED = START + ", " + _rounds(ROUNDS) + f""", fb AS (SELECT * FROM b{ROUNDS} WHERE direction IN (SELECT direction FROM b0 GROUP BY 1 HAVING count(*) >= 100)),
    fm AS (SELECT direction, model_id, -covar_pop(ell, b) / var_pop(b) AS s, avg(ell) - covar_pop(ell, b) / var_pop(b) * avg(b) AS a FROM cells JOIN fb USING (direction, item_id) GROUP BY ALL),
    other AS (SELECT direction, item_id, count(*) AS n_ref, sum(s * s) AS denom, sum(s * (a - ell)) / sum(s * s) AS b FROM (SELECT 1 - half AS direction, model_id, item_id, ell FROM obs JOIN halves USING (item_id)) JOIN fm USING (direction, model_id) GROUP BY ALL)"""


def _fitted(spark, sf):
    """Observations with halves, their rows by direction, and the fit of each direction."""
    halved = crossfit.halved(_obs(spark, sf, ["ell"])).select("model_id", "item_id", "half", "ell")
    rows = halved.withColumnRenamed("half", "direction")
    return halved, rows, structure.als_reference(rows, ["direction"], tol=TIGHT)


def _final_lines(rows, b):
    return structure.line_fit(rows.join(b, ["direction", "item_id"]), ["direction", "model_id"]).select("direction", "model_id", "a", "s")


@query("als_reference", with_obs(f"SELECT {sql_shown('direction::INT AS direction, item_id', 'b', 6)}, '' AS reason FROM fb", FITTED))
def als_reference(spark, sf):
    _, _, (b, _, status) = _fitted(spark, sf)
    return shown(b.join(status, "direction").select(F.col("direction").cast("int").alias("direction"), "item_id", "b", "reason"), 6)


@query("fitted_models", with_obs(f"SELECT {sql_shown('direction::INT AS direction, model_id', 'a; s', 6)} FROM fm", FITTED))
def fitted_models(spark, sf):
    """The reference models' lines on the fitted positions."""
    _, rows, (b, _, _) = _fitted(spark, sf)
    return shown(_final_lines(rows, b).withColumn("direction", F.col("direction").cast("int")), 6)


@query("fitted_items", with_obs(f"SELECT {sql_shown('direction::INT AS direction, item_id, n_ref', 'CASE WHEN n_ref >= 20 THEN b END AS b; denom', 6)} FROM other", FITTED))
def fitted_items(spark, sf):
    """The other half's items on those lines, in the fit's gauge."""
    halved, rows, (b, _, _) = _fitted(spark, sf)
    other = halved.select((1 - F.col("half")).alias("direction"), "model_id", "item_id", "ell")
    return shown(structure.project_reference_items(other, _final_lines(rows, b), ["direction"]).withColumn("direction", F.col("direction").cast("int")), 6)


@query("d_metrics", with_obs(f"""SELECT {sql_shown('model_id', 'CASE WHEN n = 2 THEN d1 END AS d1; CASE WHEN n = 2 THEN d2 END AS d2; CASE WHEN n = 2 THEN d3 END AS d3; CASE WHEN n = 2 THEN d4 END AS d4', 6)}, reason AS d1_reason, reason AS d2_reason, reason AS d3_reason, reason AS d4_reason FROM (
        SELECT model_id, count(*) AS n, sum(d1) / 2 AS d1, sum(d2) / 2 AS d2, sum(d3) / 2 AS d3, sum(d4) / 2 AS d4, concat_ws(';', CASE WHEN min(direction) > 0 THEN 'H0:MISSING' END, CASE WHEN max(direction) < 1 THEN 'H1:MISSING' END) AS reason FROM (
            SELECT model_id, direction, sum(pow(least(r, 0), 2)) / sum(r * r) AS d1, kurtosis_pop(r) AS d2, corr(r, b * b) AS d4, corr(x, y) AS d3 FROM (
                SELECT *, rank() OVER (PARTITION BY model_id, direction ORDER BY abs(r)) + (count(*) OVER (PARTITION BY model_id, direction, abs(r)) - 1) / 2.0::DOUBLE AS x,
                    rank() OVER (PARTITION BY model_id, direction ORDER BY b) + (count(*) OVER (PARTITION BY model_id, direction, b) - 1) / 2.0::DOUBLE AS y FROM (
                    SELECT model_id, direction, o.b, ell - (a - s * o.b) AS r, count(*) OVER (PARTITION BY model_id, direction) AS n FROM (SELECT 1 - half AS direction, model_id, item_id, ell FROM obs JOIN halves USING (item_id)) JOIN fm USING (direction, model_id) JOIN (SELECT * FROM other WHERE n_ref >= 20) o USING (direction, item_id)) WHERE n >= 100) GROUP BY ALL) GROUP BY model_id)""", FITTED))
def d_metrics(spark, sf):
    """Fit on each half, project the other half's items into that fit's gauge, then judge both directions."""
    halved, rows, (b, _, _) = _fitted(spark, sf)
    other = halved.select((1 - F.col("half")).alias("direction"), "model_id", "item_id", "ell")
    projected = structure.project_reference_items(other, _final_lines(rows, b), ["direction"]).select("direction", "item_id", "b")
    positions = structure.checkpointed(b.select("direction", "item_id", "b").unionByName(projected))
    halves = halved.select("item_id", "half").distinct()
    return shown(structure.d_metrics(halved.drop("half"), halves, positions, ["model_id"]), 6)
