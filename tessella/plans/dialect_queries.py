"""Registered queries of the slope analysis' own fit; the SQL unrolls its first five rounds."""

from __future__ import annotations

from tessella.operators import dialect, items
from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.plans.fixture_sql import with_obs
from tessella.sources import adapters

QUERIES, ORACLE_SQL = {}, {}
ROUNDS = 5


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _obs(spark, sf):
    return items.valid_observations(adapters.responses_from_lineitem(spark, sf), ["ell"])


def _lines(k: int) -> str:
    return f"l{k} AS MATERIALIZED (SELECT init, model_id, count(*) AS n, var_pop(ell) AS var_ell, -covar_pop(ell, b) / greatest(var_pop(b), 1e-12) AS s, avg(ell) - covar_pop(ell, b) / greatest(var_pop(b), 1e-12) * avg(b) AS a FROM obs JOIN b{k} USING (item_id) GROUP BY ALL)"


_SCALE = "CASE WHEN stddev_pop(v) OVER (PARTITION BY init) < 1e-12 THEN 1 ELSE stddev_pop(v) OVER (PARTITION BY init) END"
FIT = f"""b0 AS MATERIALIZED (SELECT init, item_id, (v - avg(v) OVER (PARTITION BY init)) / {_SCALE} AS b FROM (
        SELECT 'primary' AS init, item_id, -avg(ell) AS v FROM obs GROUP BY ALL
        UNION ALL SELECT 'binary', item_id, ln((1 - p) / p) FROM (SELECT item_id, greatest(1e-4, least(1 - 1e-4, avg((ell > 0)::INT))) AS p FROM obs GROUP BY 1))),
    """ + ",\n    ".join(
    f"{_lines(k)},\n    b{k + 1} AS MATERIALIZED (SELECT init, item_id, (v - avg(v) OVER (PARTITION BY init)) / {_SCALE} AS b FROM (SELECT init, item_id, sum(s * (a - ell)) / greatest(sum(s * s), 1e-12) AS v FROM obs JOIN l{k} USING (model_id) GROUP BY ALL))"
    for k in range(ROUNDS)
) + f",\n    {_lines(ROUNDS)}"


@query("dialect_positions", with_obs(f"SELECT {sql_shown('init, item_id', 'b', 6)} FROM b{ROUNDS}", FIT))
def dialect_positions(spark, sf):
    """Positions from both starts after five rounds."""
    return shown(dialect.fit(_obs(spark, sf), ROUNDS, 0.0)[0], 6)


@query("dialect_models", with_obs(f"""SELECT {sql_shown("init, model_id, n, concat_ws('|', CASE WHEN n < 50 THEN 'few_items' END, CASE WHEN var_ell < 1e-6 THEN 'degenerate_lowvar' END, CASE WHEN s <= 0 THEN 'neg_slope' END) AS flags", 's; a / s AS theta; sigma', 6)} FROM (
    SELECT init, model_id, l.n, any_value(l.var_ell) AS var_ell, any_value(l.s) AS s, any_value(l.a) AS a, stddev_pop(ell - (l.a - l.s * b)) AS sigma FROM obs JOIN b{ROUNDS} USING (item_id) JOIN l{ROUNDS} l USING (init, model_id) GROUP BY ALL)""", FIT))
def dialect_models(spark, sf):
    """Slopes, traits, residual scales and flags on those positions."""
    return shown(dialect.flagged(dialect.fit(_obs(spark, sf), ROUNDS, 0.0)[1]).select("init", "model_id", "n", "flags", "s", "theta", "sigma"), 6)


_PAIR = f"""ok AS (SELECT *, a / s AS theta FROM l{ROUNDS} WHERE n >= 50 AND var_ell >= 1e-6), pair AS (SELECT p.s AS s1, q.s AS s2, p.theta AS t1, q.theta AS t2 FROM ok p JOIN ok q ON p.model_id = q.model_id AND p.init = 'primary' AND q.init = 'binary'),
    place AS (SELECT p.b AS b1, q.b AS b2 FROM b{ROUNDS} p JOIN b{ROUNDS} q ON p.item_id = q.item_id AND p.init = 'primary' AND q.init = 'binary'), turn AS (SELECT coalesce(corr(s1, s2) < 0, false) AS flipped, CASE WHEN corr(s1, s2) < 0 THEN -1 ELSE 1 END AS g FROM pair)"""


@query("dialect_agreement", with_obs(f"""SELECT flipped, n_agree, {sql_shown('', 'r_s; r_theta; max_s; max_theta; r_b; max_b', 6)} FROM (SELECT any_value(flipped) AS flipped, count(*) AS n_agree, corr(s1, g * s2) AS r_s, corr(t1, g * t2) AS r_theta, max(abs(s1 - g * s2)) AS max_s, max(abs(t1 - g * t2)) AS max_theta FROM pair, turn),
    (SELECT corr(b1, g * b2) AS r_b, max(abs(b1 - g * b2)) AS max_b FROM place, turn)""", FIT, _PAIR))
def dialect_agreement(spark, sf):
    """How far the two starts agree after five rounds."""
    at, models, _ = dialect.fit(_obs(spark, sf), ROUNDS, 0.0)
    return shown(dialect.agreement(at, models), 6)


@query("dialect_converged")
def dialect_converged(spark, sf):
    """The same agreement after the whole fit: no SQL for its rounds."""
    at, models, _ = dialect.fit(_obs(spark, sf))
    return shown(dialect.agreement(at, models), 6)
