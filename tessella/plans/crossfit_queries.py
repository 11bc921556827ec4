"""Registered queries of context-keyed features and nested training on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import context_sums, crossfit, descriptors, features, identity, items, nested, structure, transfer
from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.plans.fixture_sql import HALVES, with_obs
from tessella.plans.model_queries import TARGET
from tessella.plans.structure_queries import NESTED
from tessella.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _population(spark, sf, values=None):
    """Observations with halves, contexts, and the members of each reference set; small or read by many branches, so written once."""
    obs = crossfit.halved(items.valid_observations(adapters.responses_from_lineitem(spark, sf), values))
    contexts = structure.checkpointed(crossfit.crossfit_contexts(obs))
    return obs, contexts, structure.checkpointed(contexts.where("role = 'reference'").select("ref_key", "org_id").distinct())


CF = NESTED + """, aux_folds AS (SELECT context AS base, org_id, (row_number() OVER (PARTITION BY context ORDER BY sha256('20260914|inner|' || org_id), org_id) - 1) % 4 AS f FROM all_members WHERE role = 'reference'),
    cf AS (SELECT context || '/scored' AS context, context AS base, 'scored' AS part, org_id, role FROM all_members
        UNION ALL SELECT base || '/aux' || j, base, 'train', org_id, CASE WHEN f = j THEN 'scored' ELSE 'reference' END FROM aux_folds, range(4) t(j))"""


@query("crossfit_contexts", with_obs("""SELECT context, base, part, org_id, role, ref_key FROM cf JOIN (SELECT context, sha256(string_agg(org_id, chr(10) ORDER BY org_id)) AS ref_key FROM cf WHERE role = 'reference' GROUP BY 1) USING (context)
        WHERE context IN (SELECT context FROM cf WHERE role = 'scored')""", CF))
def crossfit_contexts(spark, sf):
    return crossfit.crossfit_contexts(items.valid_observations(adapters.responses_from_lineitem(spark, sf))).select("context", "base", "part", "org_id", "role", "ref_key")


POSITIONS = HALVES + ", " + CF + """, hobs AS (SELECT * FROM obs JOIN halves USING (item_id)),
    ref AS (SELECT context, org_id FROM cf WHERE role = 'reference'), sco AS (SELECT context, org_id FROM cf WHERE role = 'scored'),
    sums AS (SELECT half, item_id, org_id, sum(ell) AS s, count(*) AS n FROM hobs GROUP BY ALL),
    means AS (SELECT context, half AS direction, item_id, sum(s) / sum(n) AS m FROM sums JOIN ref USING (org_id) GROUP BY ALL HAVING sum(n) >= 20),
    pos0 AS (SELECT context, direction, item_id, (avg(m) OVER w - m) / stddev_pop(m) OVER w AS b FROM means WINDOW w AS (PARTITION BY context, direction)),
    lines AS (SELECT context, direction, model_id, -covar_pop(ell, b) / var_pop(b) AS s, avg(ell) - covar_pop(ell, b) / var_pop(b) * avg(b) AS a FROM hobs JOIN ref USING (org_id) JOIN pos0 USING (context, item_id) WHERE half = direction GROUP BY ALL HAVING var_pop(b) > 1e-12),
    other AS (SELECT context, direction, item_id, sum(s * (a - ell)) / sum(s * s) AS b FROM hobs JOIN ref USING (org_id) JOIN lines USING (context, model_id) WHERE half = 1 - direction GROUP BY ALL HAVING count(*) >= 20),
    pos AS (SELECT * FROM pos0 UNION ALL SELECT * FROM other),
    rows AS (SELECT context, model_id, item_id, half, direction, ell, b FROM hobs JOIN sco USING (org_id) JOIN pos USING (context, item_id)),
    fit AS (SELECT context, model_id, direction, count(*) AS n, -covar_pop(ell, b) / var_pop(b) AS s, avg(ell) - covar_pop(ell, b) / var_pop(b) * avg(b) AS a FROM rows WHERE half = direction GROUP BY ALL HAVING var_pop(b) > 1e-12)"""

PROJECTION = """line AS (SELECT context, model_id, a, s, n, sqrt(avg(pow(ell - (a - s * b), 2))) AS sigma FROM rows JOIN fit USING (context, model_id, direction) WHERE half = 0 AND direction = 0 GROUP BY ALL),
    projected AS (SELECT context, model_id, CASE WHEN n < 100 THEN 'EVALUATION_ITEMS_LT100' WHEN s <= 1e-8 THEN 'S_LE1E8' ELSE '' END AS reason, CASE WHEN n >= 100 AND s > 1e-8 THEN a / s END AS theta, CASE WHEN n >= 100 AND s > 1e-8 THEN ln(s) END AS log_s, CASE WHEN n >= 100 AND s > 1e-8 THEN ln(sigma) END AS log_sigma FROM line)"""


@query("crossfit_projection", with_obs(f"SELECT {sql_shown('context, model_id, reason', 'theta; log_s; log_sigma', 7)} FROM projected", POSITIONS, PROJECTION))
def crossfit_projection(spark, sf):
    """Every model projected on the positions of organisations other than its own, on start positions."""
    obs, contexts, members = _population(spark, sf, ["ell"])
    out = crossfit.projections(obs, contexts, crossfit.start_positions(obs, members))
    return shown(out.select("context", "model_id", "theta", "log_s", "log_sigma", "reason"), 7)


STRUCTURE = """per_org AS (SELECT context, item_id, org_id, sum(e) AS k, count(*) AS n FROM obs JOIN ref USING (org_id) GROUP BY ALL),
    ease AS (SELECT context, item_id, 1 - avg((k + 0.5::DOUBLE) / (n + 1)) AS w FROM per_org GROUP BY ALL HAVING sum(n) >= 20),
    ranked_c AS (SELECT context, model_id, w, e, c, z, c - y::INT AS gap, floor(4 * (row_number() OVER (PARTITION BY context, model_id ORDER BY round(w, 12), item_id) - 1) / (count(*) OVER (PARTITION BY context, model_id))) AS bin FROM obs JOIN sco USING (org_id) JOIN ease USING (context, item_id)),
    c_all AS (SELECT context, model_id, avg(w * e) AS c1, avg(w * e * c) AS c2, avg(w * z) AS c3, avg(gap) AS mean, count(*) AS n FROM ranked_c GROUP BY ALL),
    cm AS (SELECT context, model_id, any_value(c1) AS c1, any_value(c2) AS c2, any_value(c3) AS c3, CASE WHEN any_value(n) >= 4 THEN sum(m / n * pow(g - mean, 2)) END AS c4 FROM (SELECT context, model_id, bin, count(*) AS m, avg(gap) AS g FROM ranked_c GROUP BY ALL) JOIN c_all USING (context, model_id) GROUP BY ALL),
    res AS (SELECT context, model_id, direction, b, ell - (a - s * b) AS r, count(*) OVER (PARTITION BY context, model_id, direction) AS n_held FROM rows JOIN fit USING (context, model_id, direction) WHERE half <> direction),
    shape AS (SELECT context, model_id, direction, sum(pow(least(r, 0), 2)) / sum(r * r) AS d1, kurtosis_pop(r) AS d2, corr(r, b * b) AS d4, corr(x, y) AS d3 FROM (
        SELECT *, rank() OVER (PARTITION BY context, model_id, direction ORDER BY abs(r)) + (count(*) OVER (PARTITION BY context, model_id, direction, abs(r)) - 1) / 2.0::DOUBLE AS x,
            rank() OVER (PARTITION BY context, model_id, direction ORDER BY b) + (count(*) OVER (PARTITION BY context, model_id, direction, b) - 1) / 2.0::DOUBLE AS y FROM res WHERE n_held >= 100) GROUP BY ALL),
    dm AS (SELECT context, model_id, sum(d1) / 2 AS d1, sum(d2) / 2 AS d2, sum(d3) / 2 AS d3, sum(d4) / 2 AS d4 FROM shape GROUP BY ALL HAVING count(*) = 2)"""


def _features(spark, sf):
    obs, contexts, members = _population(spark, sf)
    cells = context_sums.packed(obs, context_sums.Numbers(obs, members))
    positions = structure.checkpointed(crossfit.with_other_half(obs, members, structure.checkpointed(crossfit.start_positions(obs, members)), cells=cells))
    metrics = crossfit.context_metrics(obs, contexts, positions, cells=cells)
    return crossfit.feature_table(features.summaries(obs), descriptors.ab_metrics(obs), metrics, contexts)


@query("context_features", with_obs(f"""SELECT {sql_shown('context, model_id, org_id, reason', 'acc; conf; c1; c2; c3; c4; d1; d2; d3; d4; theta; log_s; log_sigma', 6)}
        FROM (SELECT DISTINCT context, model_id, org_id FROM obs JOIN sco USING (org_id)) JOIN (SELECT model_id, avg(y::INT) AS acc, avg(c) AS conf FROM obs GROUP BY 1) USING (model_id)
        LEFT JOIN cm USING (context, model_id) LEFT JOIN dm USING (context, model_id) LEFT JOIN projected USING (context, model_id)""", POSITIONS, PROJECTION, STRUCTURE))
def context_features(spark, sf):
    """The table that training reads: summaries, C and D metrics and the projection of each model in each context."""
    return shown(_features(spark, sf).select("context", "model_id", "org_id", "reason", "acc", "conf", *crossfit.C, *crossfit.D, "theta", "log_s", "log_sigma"), 6)


def _training_table(spark, sf):
    targets = features.score_targets(items.valid_observations(adapters.responses_from_lineitem(spark, sf, True), ["c", "y", "e"])).select("model_id", "y_cal", "y_sel")
    return structure.checkpointed(_features(spark, sf).join(targets, "model_id"))


@query("nested_grid")
def nested_grid(spark, sf):
    """The full design: 31 packages, 17 configurations, two targets, five outer by four inner folds, two procedures."""
    return shown(nested.run(_training_table(spark, sf))[0])


CHOICE = TARGET + """, goal AS (SELECT model_id, avg(e) FILTER (rn <= (n + 1) // 2) AS y_sel FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY c DESC, item_id) AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM tobs) GROUP BY 1),
    feat AS (SELECT base, part, m.model_id, m.org_id, acc, c1, y_sel FROM (SELECT context, model_id, any_value(org_id) AS org_id FROM obs JOIN sco USING (org_id) GROUP BY ALL) m JOIN (SELECT DISTINCT context, base, part FROM cf) USING (context)
        JOIN (SELECT model_id, avg(y::INT) AS acc FROM obs GROUP BY 1) USING (model_id) JOIN goal USING (model_id) LEFT JOIN cm USING (context, model_id)),
    long AS (SELECT base, part, model_id, org_id, y_sel AS y, 'B0' AS package, acc AS x FROM feat UNION ALL SELECT base, part, model_id, org_id, y_sel, 'P_c1', c1 FROM feat),
    med AS (SELECT base, package, median(x) AS med FROM long WHERE part = 'train' GROUP BY ALL),
    filled AS (SELECT base, part, model_id, org_id, y, package, coalesce(x, med, 0.0::DOUBLE) AS x FROM long JOIN med USING (base, package)),
    orgs AS (SELECT base, package, org_id, count(*) AS k FROM filled WHERE part = 'train' GROUP BY ALL),
    v AS (SELECT base, package, org_id, 1.0::DOUBLE / (k * count(*) OVER (PARTITION BY base, package)) AS v FROM orgs),
    mom AS (SELECT base, package, sum(v * x) AS mx, sum(v * y) AS my, sum(v * x * x) - sum(v * x) * sum(v * x) AS vx, sum(v * x * y) - sum(v * x) * sum(v * y) AS cxy FROM filled JOIN v USING (base, package, org_id) WHERE part = 'train' GROUP BY ALL),
    told AS (SELECT substr(base, 2, 1)::INT AS fold, base LIKE '%i%' AS inside, model_id, org_id, y, package, lam, greatest(0.0::DOUBLE, least(1.0::DOUBLE, my + CASE WHEN sqrt(greatest(vx, 0.0::DOUBLE)) > 1e-12 THEN cxy / (vx * (1 + lam)) * (x - mx) ELSE 0.0::DOUBLE END)) AS pred
        FROM filled JOIN mom USING (base, package), (SELECT unnest([1e-4::DOUBLE, 1e-3, 1e-2, 1e-1, 1, 10, 100, 1000, 10000]) AS lam) WHERE part = 'scored'),
    loss AS (SELECT fold, package, lam, avg(m) AS loss FROM (SELECT fold, package, lam, org_id, avg(pow(y - pred, 2)) AS m FROM told WHERE inside GROUP BY ALL) GROUP BY ALL),
    best AS (SELECT fold, package, arg_max(lam, lam) AS lam, arg_max(loss, lam) AS loss FROM (SELECT *, min(loss) OVER (PARTITION BY fold, package) AS low FROM loss) WHERE loss <= low + 1e-12 GROUP BY ALL),
    final AS (SELECT model_id, org_id, t.fold, package, pred FROM told t JOIN best USING (fold, package, lam) WHERE NOT inside),
    there AS (SELECT substr(base, 2, 1)::INT AS fold, min(k) > 0 AS c1_there FROM (SELECT base, count(c1) AS k FROM feat WHERE part = 'train' GROUP BY base) GROUP BY 1),
    pick AS (SELECT fold, CASE WHEN NOT any_value(c1_there) OR max(loss) FILTER (package = 'B0') <= min(loss) + 1e-12 THEN 'B0' ELSE 'P_c1' END AS package FROM best JOIN there USING (fold) GROUP BY fold)"""


@query("nested_selection", with_obs(f"SELECT {sql_shown('model_id, org_id, outer_fold, package', 'pred', 6)} FROM (SELECT model_id, org_id, fold AS outer_fold, package, pred FROM final UNION ALL SELECT model_id, org_id, fold, 'SP', pred FROM final JOIN pick USING (fold, package))", POSITIONS, STRUCTURE, CHOICE))
def nested_selection(spark, sf):
    """Two packages of the nested design, a context-keyed one among them, and the procedure that chooses between them."""
    preds, _ = nested.run(_training_table(spark, sf), {"B0": ["acc"], "P_c1": ["c1"]}, ("y_sel",), {"SP": ["B0", "P_c1"]}, families=("ridge",))
    return shown(preds.where("algorithm = 'best'").select("model_id", "org_id", F.col("outer").cast("int").alias("outer_fold"), "package", "pred"), 6)


def _transferred(spark, sf, fitted):
    """Slopes and traits on start positions of the first benchmark, carried to the second one."""
    flags = ("source", "target")
    both = structure.checkpointed(items.valid_observations(adapters.lines_by_model(spark, sf), ["ell"], flags, adapters.responses_of_both))
    obs, target = (both.where(k).drop(*flags) for k in flags)
    everyone = obs.withColumn("k", F.lit(0))
    start = structure.initial_positions(everyone, ["k"]).where("b IS NOT NULL").drop("k")
    source = structure.line_fit(obs.join(F.broadcast(start), "item_id"), ["model_id", "org_id"]).select("model_id", "org_id", "s", (F.col("a") / F.when(F.col("s") > 1e-8, F.col("s"))).alias("theta"))  # start: items of the benchmark
    return transfer.transfer(source, target, fitted=fitted, least_models=5 if not fitted else 20)


def _dealt(n: int) -> str:
    """One shuffle of n organisations by the published generator, as SQL values; there are at most 25 organisations."""
    import numpy as np

    return ", ".join(f"({int(g)}, {k % 2})" for k, g in enumerate(np.random.default_rng(transfer.SEED).permutation(n)))


TRANSFER = TARGET + f""", m0 AS (SELECT item_id, avg(ell) AS m FROM obs GROUP BY 1 HAVING count(*) >= 20), p0 AS (SELECT item_id, (avg(m) OVER () - m) / stddev_pop(m) OVER () AS b FROM m0),
    src AS (SELECT model_id, org_id, s, a / s AS theta FROM (SELECT model_id, org_id, -covar_pop(ell, b) / var_pop(b) AS s, avg(ell) - covar_pop(ell, b) / var_pop(b) * avg(b) AS a FROM obs JOIN p0 USING (item_id) GROUP BY ALL) WHERE s > 1e-8),
    goal AS (SELECT model_id, avg((ell > 0)::INT) AS acc, avg(1 / (1 + exp(-abs(ell)))) - avg((ell > 0)::INT) AS over FROM tobs GROUP BY 1),
    part AS (SELECT * FROM src JOIN goal USING (model_id)),
    numbered AS (SELECT org_id, row_number() OVER (ORDER BY org_id) - 1 AS g, count(*) OVER () AS n FROM (SELECT DISTINCT org_id FROM part)),
    deals AS ({{deals}}),
    taking AS (SELECT part.*, fold FROM part JOIN numbered USING (org_id) JOIN deals USING (g, n)),
    tm AS (SELECT fold, item_id, avg(ell) AS m FROM tobs JOIN taking USING (model_id) GROUP BY ALL HAVING count(*) >= 5),
    tp AS (SELECT fold, item_id, (avg(m) OVER (PARTITION BY fold) - m) / stddev_pop(m) OVER (PARTITION BY fold) AS b FROM tm),
    tl AS (SELECT model_id, -covar_pop(ell, b) / var_pop(b) AS st FROM tobs JOIN taking USING (model_id) JOIN tp USING (fold, item_id) GROUP BY ALL),
    scale AS (SELECT 1 - fold AS fold, exp(avg(CASE WHEN st > 0 THEN ln(st) - ln(s) END)) AS c, median(s) AS med FROM taking LEFT JOIN tl USING (model_id) GROUP BY fold),
    bs AS (SELECT 1 - fold AS fold, list(b ORDER BY b) AS bs FROM tp GROUP BY fold),
    rows_ AS (SELECT model_id, org_id, fold, acc, over, theta, v AS variant, CASE v WHEN 'rescale' THEN c * s WHEN 'median' THEN c * med ELSE s END AS s, bs FROM taking JOIN scale USING (fold) JOIN bs USING (fold), (SELECT unnest(['rescale', 'median', 'literal']) AS v)),
    halving AS (SELECT model_id, variant, 0 AS k, -60.0::DOUBLE AS low, 60.0::DOUBLE AS high FROM rows_ UNION ALL
        SELECT model_id, variant, k + 1, CASE WHEN under THEN (low + high) / 2 ELSE low END, CASE WHEN under THEN high ELSE (low + high) / 2 END FROM (
            SELECT h.*, list_avg(list_transform(bs, lambda b: 1 / (1 + exp(-s * ((low + high) / 2 - b))))) < acc AS under FROM halving h JOIN rows_ USING (model_id, variant) WHERE k < 64)),
    there AS (SELECT model_id, variant, (low + high) / 2 AS t FROM halving WHERE k = 64),
    nodes AS (SELECT list(ln((i + 0.5::DOUBLE) / 64 / (1 - (i + 0.5::DOUBLE) / 64)) ORDER BY i) AS e FROM range(64) t(i)),
    told AS (SELECT model_id, org_id, fold, variant, acc, over, list_avg(list_transform(bs, lambda b: 1 / (1 + exp(-s * (theta - b))))) AS pred_acc,
        list_avg(list_transform(bs, lambda b: list_avg(list_transform(e, lambda x: 1 / (1 + exp(-abs(s * (t - b) + x))))))) - acc AS pred_over FROM rows_ JOIN there USING (model_id, variant), nodes)"""
TRANSFER = TRANSFER.format(deals=" UNION ALL ".join(f"SELECT *, {n} AS n FROM (VALUES {_dealt(n)}) t(g, fold)" for n in range(1, 26)))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("transfer_predictions", _recursive(with_obs(f"SELECT {sql_shown('model_id, org_id, fold, variant', 'acc; over; pred_acc; pred_over', 6)} FROM told", TRANSFER)))
def transfer_predictions(spark, sf):
    """Accuracy and overconfidence on the second benchmark from the other fold's items, for three slopes."""
    return shown(_transferred(spark, sf, False), 6)


@query("transfer_r2", _recursive(with_obs(f"SELECT {sql_shown('variant, count(*) AS n', '1 - avg(pow(acc - pred_acc, 2)) / var_pop(acc) AS r2_acc; 1 - avg(pow(over - pred_over, 2)) / var_pop(over) AS r2_over', 5)} FROM told GROUP BY variant", TRANSFER)))
def transfer_r2(spark, sf):
    return shown(transfer.r2(_transferred(spark, sf, False), ["variant"]), 5)


@query("transfer_intervals")
def transfer_intervals(spark, sf):
    """Intervals of the same, on fitted positions."""
    return shown(transfer.r2_intervals(structure.checkpointed(_transferred(spark, sf, True))), 6)


@query("cached_directions", with_obs(f"SELECT {sql_shown('ref_key, direction::INT AS direction, item_id, 0 AS fitted_again', 'b', 7)} FROM pos0 JOIN (SELECT context, sha256(string_agg(org_id, chr(10) ORDER BY org_id)) AS ref_key FROM ref GROUP BY 1) USING (context) WHERE context IN ('o0/scored', 'o1/scored', 'o2/scored', 'o3/scored', 'o4/scored')", POSITIONS))
def cached_directions(spark, sf):
    """Directions of the five outer sets as the second call finds them in the store, and how many sets that call fitted."""
    import uuid

    obs, contexts, _ = _population(spark, sf)
    members = structure.checkpointed(contexts.where("inner IS NULL AND part = 'scored' AND role = 'reference'").select("ref_key", "org_id"))
    path = f"{spark.sparkContext.getCheckpointDir()}/directions-{uuid.uuid4().hex}"  # set by the first checkpoint above
    crossfit.cached_positions(obs, members, path, crossfit.start_positions)
    again, fitted = crossfit.cached_positions(obs, members, path, crossfit.start_positions)
    return shown(again.withColumn("fitted_again", F.lit(fitted)), 7)


@query("canonical_digest", """WITH t AS (SELECT *, concat_ws(chr(31), 'N' || c_custkey::DOUBLE::VARCHAR, 'N' || c_acctbal::DOUBLE::VARCHAR) AS r FROM customer),
    a AS (SELECT r, row_number() OVER (ORDER BY c_custkey, r) - 1 AS p FROM t), b AS (SELECT p // 1000 AS p, sha256(string_agg(r, chr(10) ORDER BY p)) AS r FROM a GROUP BY p // 1000),
    c AS (SELECT p // 1000 AS p, sha256(string_agg(r, chr(10) ORDER BY p)) AS r FROM b GROUP BY p // 1000), last AS (SELECT CASE WHEN (SELECT count(*) FROM b) > 1 THEN (SELECT max(r) FROM c) ELSE (SELECT max(r) FROM b) END AS r)
    SELECT (SELECT count(*) FROM customer) AS n, 'Sc_custkey' || chr(31) || 'Sc_acctbal' AS header, sha256('Sc_custkey' || chr(31) || 'Sc_acctbal' || chr(10) || r) AS digest FROM last""")
def canonical_digest(spark, sf):
    return identity.canonical_digest(adapters.table(spark, sf, "customer"), ["c_custkey"], ["c_custkey", "c_acctbal"])


@query("column_records", """SELECT 'l_quantity' AS "column", count(*) AS n, count(*) FILTER (l_quantity IS NULL) AS nulls, 0::BIGINT AS nan, 0::BIGINT AS posinf, 0::BIGINT AS neginf, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most FROM lineitem
    UNION ALL SELECT 'l_tax', count(*), count(*) FILTER (l_tax IS NULL), 0, 0, 0, min(l_tax)::DOUBLE, max(l_tax)::DOUBLE FROM lineitem""")
def column_records(spark, sf):
    return identity.column_records(adapters.table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])


BROKEN = """cohort AS (SELECT DISTINCT model_id, org_id FROM obs), due AS (SELECT base, model_id, org_id, CASE part WHEN 'scored' THEN 'scored' ELSE 'reference' END AS role FROM cf JOIN cohort USING (org_id) WHERE role = 'scored')"""


@query("contract_check", with_obs("""SELECT 'ROW_MISSING' AS invariant, count(*) AS violations FROM due WHERE model_id::INT % 10 = 3
    UNION ALL SELECT 'NEVER_EVALUATED', count(DISTINCT model_id) FROM due WHERE model_id::INT % 10 = 3
    UNION ALL SELECT 'ROW_NOT_DUE', count(*) FROM due WHERE model_id::INT % 10 = 4
    UNION ALL SELECT 'ROW_LISTED_TWICE', count(*) FROM due WHERE model_id::INT % 10 = 4""", CF, BROKEN))
def contract_check(spark, sf):
    """What the contract says of a cohort whose rows for one model in ten are left out, and for another are listed in both roles."""
    obs = structure.checkpointed(items.valid_observations(adapters.responses_from_lineitem(spark, sf)).select("model_id", "org_id").distinct())
    contexts = structure.checkpointed(crossfit.crossfit_contexts(obs))
    asked = contexts.where("role = 'scored'").select("base", "org_id", F.when(F.col("part") == "scored", "scored").otherwise("reference").alias("role"))
    listed = asked.join(obs, "org_id").where("CAST(model_id AS INT) % 10 <> 3")
    twice = listed.where("CAST(model_id AS INT) % 10 = 4").withColumn("role", F.when(F.col("role") == "scored", "reference").otherwise("scored"))
    checked = identity.contract(contexts, obs, structure.folds(obs, 5), listed.unionByName(twice), n_contexts=None)
    return checked.where("invariant IN ('ROW_MISSING', 'NEVER_EVALUATED', 'ROW_NOT_DUE', 'ROW_LISTED_TWICE') OR violations > 0 AND invariant NOT IN ('EVALUATED_TWICE', 'OUTER_FOLD_COUNT', 'INNER_FOLD_COUNT', 'BASE_CONTEXT_COUNT')")
