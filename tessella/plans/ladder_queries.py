"""Registered queries of the covariate ladders, with least squares in SQL by successive orthogonalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import items, ladders, structure
from tessella.operators.ladders import BASES, RUNGS, TRAITS
from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.plans.fixture_sql import observations, responses, with_obs
from tessella.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _traits(spark, sf):
    """Moment estimates of the traits on both benchmarks: logits of accuracy, and of mean confidence beyond it."""
    out = []
    for bench, target in (("source", False), ("target", True)):
        obs = items.valid_observations(adapters.responses_from_lineitem(spark, sf, target))
        g = obs.groupBy("model_id").agg(
            F.avg(F.col("y").cast("double")).alias("acc"), F.avg("c").alias("conf"), F.avg("depth").alias("resp"), F.avg("margin").alias("gauge"), F.avg("z").alias("tok_len"), F.sum(F.col("y").cast("double")).alias("k"), F.count("*").alias("n"),
        )
        theta = F.log((F.col("k") + 0.5) / (F.col("n") - F.col("k") + 0.5))
        out.append(g.select(F.lit(bench).alias("bench"), "model_id", theta.alias("theta_a"), (F.log(F.col("conf") / (1 - F.col("conf"))) - theta).alias("theta_c"), "acc", "resp", "conf", "gauge", "tok_len", (F.col("resp") - F.col("acc")).alias("signed")))
    return structure.checkpointed(out[0].unionByName(out[1]))  # a row per benchmark and model


def _side(bench: str, obs: str) -> str:
    return f"""SELECT '{bench}' AS bench, model_id, t AS theta_a, ln(conf / (1 - conf)) - t AS theta_c, acc, resp, conf, gauge, tok_len, resp - acc AS signed FROM (
        SELECT model_id, avg(y::INT) AS acc, avg(c) AS conf, avg(depth) AS resp, avg(margin) AS gauge, avg(z) AS tok_len, ln((count(*) FILTER (y) + 0.5::DOUBLE) / (count(*) FILTER (NOT y) + 0.5::DOUBLE)) AS t FROM {obs} GROUP BY 1)"""


TARGET = f"{responses('tresp', True)},\n{observations('tobs', 'tresp')}"
_ZS = ", ".join(f"(({c}) - avg({c}) OVER w) / (stddev_pop({c}) OVER w + 1e-12) AS z_{c}" for c in TRAITS)
TABLES = f"""traits AS ({_side('source', 'obs')} UNION ALL {_side('target', 'tobs')}),
    scored AS (SELECT *, {_ZS} FROM traits WINDOW w AS (PARTITION BY bench))"""


def _orthogonal(tag: str, covariates: list[str], targets: list[str]) -> str:
    """Tables that take each covariate out of the later ones and of the targets, one after another, twice over for precision."""
    p = len(covariates)
    xs, ys = [f"x{i}" for i in range(p)], [f"r_{t}" for t in targets]
    centred = [f"({' * '.join('z_' + f for f in c.split('*'))}) AS {x}" for c, x in zip(covariates, xs)] + [f"{t} AS {y}" for t, y in zip(targets, ys)]
    parts = [f"{tag}_raw AS (SELECT bench, model_id, {', '.join(centred)} FROM scored)"]
    parts.append(f"{tag}_0 AS (SELECT bench, model_id, {', '.join(f'{c} - avg({c}) OVER w AS {c}' for c in xs + ys)} FROM {tag}_raw WINDOW w AS (PARTITION BY bench))")
    steps = [(i, [*xs[i + 1 :], *ys]) for i in range(p)] + [(i, [*xs[i + 1 :], *ys]) for i in range(p)]
    for k, (i, later) in enumerate(steps):
        keep = [c for c in xs if c not in later]
        cut = [f"{c} - CASE WHEN sum(x{i} * x{i}) OVER w > 1e-18 THEN sum({c} * x{i}) OVER w / sum(x{i} * x{i}) OVER w ELSE 0 END * x{i} AS {c}" for c in later]
        parts.append(f"{tag}_{k + 1} AS MATERIALIZED (SELECT bench, model_id, {', '.join([*keep, *cut])} FROM {tag}_{k} WINDOW w AS (PARTITION BY bench))")
    return ",\n".join(parts)


def _residuals(rungs: dict[str, list[str]], targets: list[str]) -> tuple[list[str], str]:
    tables = [_orthogonal(f"f{j}", cs, targets) for j, cs in enumerate(rungs.values())]
    last = " UNION ALL ".join(f"SELECT bench, model_id, '{n}' AS rung, {', '.join(f'r_{t}' for t in targets)} FROM f{j}_{2 * len(cs)}" for j, (n, cs) in enumerate(rungs.items()))
    return tables, f"res AS ({last})"


_TABLES, _RES = _residuals(RUNGS, ["theta_c", "conf"])
_STATS = """stats AS (SELECT rung, bench, var_pop(r_theta_c) AS v, var_pop(r_theta_c) / (var_pop(theta_c) + 1e-12) AS share, CASE WHEN var_pop(r_theta_c) / (var_pop(theta_c) + 1e-12) > 1e-9 THEN corr(r_theta_c, theta_a) END AS wt,
        CASE WHEN rung LIKE 'wide%' AND var_pop(r_theta_c) / (var_pop(theta_c) + 1e-12) > 1e-9 THEN corr(r_theta_c, r_conf) END AS wc FROM res JOIN traits USING (bench, model_id) GROUP BY rung, bench),
    pairs AS (SELECT a.rung, corr(a.r_theta_c, b.r_theta_c) AS r, count(*) AS n_pairs FROM res a JOIN res b ON a.rung = b.rung AND a.model_id = b.model_id AND a.bench = 'source' AND b.bench = 'target' GROUP BY 1)"""


@query("residual_ladders", with_obs(f"""SELECT {sql_shown("rung, n_pairs, CASE WHEN rung NOT LIKE 'wide%' THEN '' WHEN sign(s.wc) = sign(t.wc) THEN 'SAME' ELSE 'NOT_SAME' END AS signs",
    'CASE WHEN s.share > 1e-9 AND t.share > 1e-9 THEN r END AS corr; s.share AS share_a; t.share AS share_b; 1 - s.share AS r2_a; 1 - t.share AS r2_b; s.v AS var_a; t.v AS var_b; s.wt AS with_theta_a; t.wt AS with_theta_b; s.wc AS with_conf_a; t.wc AS with_conf_b', 6)}
    FROM pairs JOIN (SELECT * FROM stats WHERE bench = 'source') s USING (rung) JOIN (SELECT * FROM stats WHERE bench = 'target') t USING (rung)""", TARGET, TABLES, *_TABLES, _RES, _STATS))
def residual_ladders(spark, sf):
    return shown(ladders.ladder_table(_traits(spark, sf), "source", "target"), 6)


@query("ladder_nulls")
def ladder_nulls(spark, sf):
    """200 permutations of every rung from one generator: no SQL, NumPy's stream."""
    return shown(ladders.null_summary(ladders.ladder_nulls(_traits(spark, sf), "source", "target")), 6)


_BASE_TABLES, _BASE_RES = _residuals(BASES, ["theta_c"])
_PLAIN = " UNION ALL ".join(
    [f"SELECT bench, '{a}~{b}' AS name, corr({a}, {b}) AS value FROM traits GROUP BY 1" for a, b in ladders.WITHIN] + [f"SELECT bench, 'std_{c}', stddev_pop({c}) FROM traits GROUP BY 1" for c in TRAITS if c != "signed"]
)
_LEFT = "l AS (SELECT bench, rung, var_pop(r_theta_c) AS v, var_pop(r_theta_c) / (var_pop(theta_c) + 1e-12) AS share, corr(r_theta_c, conf) AS wc FROM res JOIN traits USING (bench, model_id) GROUP BY ALL)"


@query("trait_loadings", with_obs(f"""SELECT {sql_shown('bench, name', 'value', 6)} FROM ({_PLAIN}
    UNION ALL SELECT bench, rung || '_share', share FROM l UNION ALL SELECT bench, rung || '_r2', 1 - share FROM l UNION ALL SELECT bench, rung || '_var', v FROM l UNION ALL SELECT bench, rung || '_with_conf', CASE WHEN share > 1e-9 THEN wc END FROM l)""", TARGET, TABLES, *_BASE_TABLES, _BASE_RES, _LEFT))
def trait_loadings(spark, sf):
    return shown(ladders.loadings(_traits(spark, sf)), 6)


_ONE_TABLES, _ONE_RES = _residuals({"acc": ["acc"]}, ["theta_a"])
_ACROSS = ", ".join(f"corr(a.{c}, b.{c}) AS {c}" for c in ladders.ACROSS)


@query("traits_across", with_obs(f"""SELECT {sql_shown('name, n', 'value', 6)} FROM (UNPIVOT (SELECT count(*) AS n, {_ACROSS}, corr(a.r_theta_a, b.r_theta_a) AS theta_a_left FROM both_cols a JOIN both_cols b ON a.model_id = b.model_id AND a.bench = 'source' AND b.bench = 'target')
    ON {', '.join([*ladders.ACROSS, 'theta_a_left'])} INTO NAME name VALUE value)""", TARGET, TABLES, *_ONE_TABLES, _ONE_RES, "both_cols AS (SELECT * FROM traits JOIN res USING (bench, model_id))"))
def traits_across(spark, sf):
    return shown(ladders.across(_traits(spark, sf), "source", "target"), 6)
