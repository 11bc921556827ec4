"""Registered queries of the frozen cohort, the item matrix and the deny list."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import cohort, descriptors, items, structure
from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.plans.fixture_sql import HALVES, with_obs
from tessella.sources import adapters

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _dimensions(spark, sf):
    """``model_id, org_id, k, n`` (correct ones, all) and ``item_id`` of the observed table, written once: the rules read them in some twenty branches."""
    obs = items.valid_observations(adapters.responses_from_lineitem(spark, sf))
    per = obs.groupBy("model_id", "org_id").agg(F.sum(F.col("y").cast("double")).alias("k"), F.count("*").alias("n"), F.collect_set(F.col("item_id").cast("int")).alias("_items"))
    per = structure.checkpointed(per)  # both from one pass; a model's items are one benchmark's
    return per.select("model_id", "org_id", "k", "n"), structure.checkpointed(per.select(F.explode("_items").alias("item_id")).distinct().select(F.col("item_id").cast("string").alias("item_id")))


def _cohort(spark, sf):
    """The observed table as frozen, and a newer one in which every rule is broken somewhere."""
    seen, known = _dimensions(spark, sf)
    seen = seen.select("model_id", "org_id")
    m, i = F.col("model_id").cast("int"), F.col("item_id").cast("int")
    models = seen.where(m % 10 != 7).withColumn("org_id", F.when(m % 10 == 3, F.concat("org_id", F.lit("x"))).otherwise(F.col("org_id")))
    listed = seen.where(m % 10 != 9).withColumn("place", m).unionByName(seen.where(m % 10 == 4).withColumn("place", -m))
    listed_items = descriptors.item_halves(known).withColumn("place", i)
    kept = known.where(i % 50 != 0)
    new = kept.join(descriptors.item_halves(kept), "item_id").withColumn("place", F.when(i % 60 == 1, i - 5).otherwise(i)).withColumn("half", F.when(i % 40 == 2, 1 - F.col("half")).otherwise(F.col("half")))
    policy = listed_items.select("item_id").where((i % 100 == 0) | (i % 100 == 7))
    return models, listed, new, listed_items, policy


COHORT = HALVES + """, seen AS (SELECT DISTINCT model_id, org_id, model_id::INT AS m FROM obs), models AS (SELECT model_id, CASE WHEN m % 10 = 3 THEN org_id || 'x' ELSE org_id END AS org_id FROM seen WHERE m % 10 <> 7),
    listed AS (SELECT * FROM seen WHERE m % 10 <> 9 UNION ALL SELECT * FROM seen WHERE m % 10 = 4),
    old AS (SELECT item_id, item_id::INT AS place, half FROM halves),
    dealt AS (SELECT item_id, item_id::INT AS i, (row_number() OVER (ORDER BY sha256('20260914|' || item_id), item_id) - 1) % 2 AS rule FROM old WHERE place % 50 <> 0),
    fresh AS (SELECT item_id, i, rule, CASE WHEN i % 60 = 1 THEN i - 5 ELSE i END AS place, CASE WHEN i % 40 = 2 THEN 1 - rule ELSE rule END AS half FROM dealt)"""


@query("cohort_problems", with_obs("""SELECT DISTINCT 'MODEL_ABSENT' AS problem, model_id AS id FROM listed WHERE model_id NOT IN (SELECT model_id FROM models)
    UNION ALL SELECT 'MODEL_REPEATED', model_id FROM listed GROUP BY model_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT 'ORG_DIFFERS', model_id FROM listed l JOIN models n USING (model_id) WHERE l.org_id <> n.org_id
    UNION ALL SELECT 'ITEM_LOST', item_id FROM old WHERE place % 50 = 0 AND place % 100 NOT IN (0, 7)
    UNION ALL SELECT 'POLICY_ITEM_KEPT', item_id FROM fresh WHERE i % 100 IN (0, 7)
    UNION ALL SELECT 'ITEM_ORDER', item_id FROM (SELECT item_id, i, lag(i) OVER (ORDER BY place, item_id) AS before FROM fresh) WHERE i < before
    UNION ALL SELECT 'HALF_RULE', item_id FROM fresh WHERE half <> rule""", COHORT))
def cohort_problems(spark, sf):
    return cohort.cohort_problems(*_cohort(spark, sf))


@query("cohort_summary", with_obs("""SELECT (SELECT count(*) FROM models) AS n_full, (SELECT count(*) FROM models WHERE model_id NOT IN (SELECT model_id FROM listed)) AS n_outside, (SELECT count(DISTINCT model_id) FROM listed) AS n_models, (SELECT count(DISTINCT org_id) FROM listed) AS n_orgs,
    (SELECT count(*) FROM fresh) AS n_items, (SELECT count(*) FROM old) - (SELECT count(*) FROM fresh) AS n_removed, (SELECT count(*) FROM fresh WHERE half = 0) AS n_first, (SELECT count(*) FROM fresh WHERE half = 1) AS n_second,
    (SELECT count(*) FROM fresh f JOIN old o USING (item_id) WHERE f.half <> o.half) AS n_changed""", COHORT))
def cohort_summary(spark, sf):
    return cohort.cohort_summary(*_cohort(spark, sf)[:4])


@query("frozen_rows", with_obs(f"SELECT {sql_shown('model_id, place', 'avg(y::INT) AS acc')} FROM obs JOIN (SELECT DISTINCT model_id, -(model_id::INT) AS place FROM obs WHERE model_id::INT % 10 <> 9) USING (model_id) GROUP BY ALL"))
def frozen_rows(spark, sf):
    """The same cohort with nothing broken: rows of the frozen models in the frozen order."""
    per, known = _dimensions(spark, sf)
    m = F.col("model_id").cast("int")
    models = per.select("model_id", "org_id")
    listed = models.where(m % 10 != 9).withColumn("place", -m)
    now = descriptors.item_halves(known).withColumn("place", F.col("item_id").cast("int"))
    acc = per.groupBy("model_id").agg((F.sum("k") / F.sum("n")).alias("acc"))
    return shown(cohort.frozen_rows(acc, listed, cohort.cohort_problems(models, listed, now, now, now.limit(0))))


@query("matrix_cells", """WITH c AS (SELECT vec_id AS i, m FROM embeddings, range(16) t(m) WHERE NOT (vec_id % 3 = 0 AND (vec_id * 7 + m) % 16 = 0)),
    k AS (SELECT i FROM c WHERE i % 11 <> 0 GROUP BY i HAVING count(*) >= 0.95 * (SELECT count(DISTINCT m) FROM c)) SELECT m::VARCHAR AS model_id, i::VARCHAR AS item_id FROM c JOIN k USING (i)""")
def matrix_cells(spark, sf):
    """Items that 95 % of the models have, on the fully observed benchmark with cells taken out."""
    cells = items.cells(adapters.responses_from_embeddings(spark, sf))
    i, m = F.col("item_id").cast("long"), F.col("model_id").cast("long")
    some = cells.where(~((i % 3 == 0) & ((i * 7 + m) % 16 == 0)))
    return cohort.matrix_cells(some, cells.select("item_id").where(i % 11 == 0)).select("model_id", "item_id")


@query("relabelled", with_obs("SELECT model_id, item_id, n_before, n_denied, n_before - n_denied AS n_kept FROM obs JOIN (SELECT model_id, count(*) AS n_before, count(*) FILTER (item_id::INT % 15 = 2) AS n_denied FROM obs GROUP BY 1) USING (model_id) WHERE item_id::INT % 15 <> 2"))
def relabelled(spark, sf):
    obs = items.valid_observations(adapters.responses_from_lineitem(spark, sf)).select("model_id", "item_id")
    return cohort.relabelled(obs, obs.select("item_id").where(F.col("item_id").cast("int") % 15 == 2))
