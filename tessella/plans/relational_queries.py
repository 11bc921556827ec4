"""Registered queries over joins, sets, de-duplication, eligibility and text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as x
from tessella.functions.stats import z_score
from tessella.operators import descriptors, items, relational as r, report, structure
from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.plans.fixture_sql import HALVES, observations, responses, with_obs
from tessella.plans.structure_queries import MEMBERS, NESTED
from tessella.sources import adapters
from tessella.sources.adapters import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _obs(spark, sf, target=False):
    return items.valid_observations(adapters.responses_from_lineitem(spark, sf, target))


TARGET = f"{responses('tresp', True)},\n{observations('tobs', 'tresp')}"


@query("text_norm", "SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, regexp_replace(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' [title]', '. '), '\\[.*?\\]', '', 'g').replace('  ', ' ') AS cleaned FROM benchmark")
def text_norm(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", x.norm(F.col("text")).alias("key"), x.clean_context(F.col("text")).alias("cleaned"))


@query("text_segments", "SELECT doc_id, regexp_extract(text, '(?s)([^\\n]*)$', 1) AS last_line, split_part(text, '. ', 1) AS first_sentence, upper(left(lang, 1)) || lower(lang[2:]) AS lang_name FROM documents")
def text_segments(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.last_segment(F.col("text"), "\n").alias("last_line"), x.before(F.col("text"), ". ").alias("first_sentence"), x.capitalize(F.col("lang")).alias("lang_name"))


@query("json_scalars", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k, count(*) FILTER (TRY_CAST(props->>'k' AS INT) % 2 = 0) AS even FROM events GROUP BY event_type")
def json_scalars(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") % 2 == 0).alias("even"))


@query("json_lists", "SELECT user_id % 50 AS u, count(*) AS n, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS n_lists FROM events GROUP BY 1")
def json_lists(spark, sf):
    """Lists written as JSON: whole, with a null, or cut short."""
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id")
    written = F.when(e % 5 == 0, F.concat(F.lit("["), k, F.lit(",null]"))).when(e % 7 == 0, F.lit("no list")).otherwise(F.concat(F.lit("["), k, F.lit(",1]")))
    rows = table(spark, sf, "events").select((F.col("user_id") % 50).alias("u"), x.decoded_list(written).alias("l"))
    return rows.groupBy("u").agg(F.count("*").alias("n"), F.count("l").alias("n_lists"))


@query("token_counts", "SELECT vec_id, greatest(1, len(list_filter(embedding[1:8], lambda v: v > 0))) AS t0, 1 AS t1 FROM embeddings")
def token_counts(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(F.filter(F.slice("embedding", 1, 8), lambda v: v > 0)).alias("tokens"))
    t = rows.select("vec_id", x.token_counts(F.col("tokens"), 2).alias("t"))
    return t.select("vec_id", F.col("t")[0].alias("t0"), F.col("t")[1].alias("t1"))


@query("accuracy_flag", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN round_even(l_quantity / 4, 0) ELSE round_even(l_quantity / 2, 0) END::INT AS acc FROM lineitem")
def accuracy_flag(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.accuracy_flag(F.when(F.col("l_linenumber") % 2 == 0, q / 4), q / 2).alias("acc"))


_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'details_' || p_brand || '__' || p_name WHEN 1 THEN p_brand || '/' || p_partkey WHEN 2 THEN p_brand ELSE 'results_' || p_brand || '__a__b' END"


@query("model_identity", f"""SELECT p_partkey, name, replace(name, '/', '__') AS file, CASE WHEN regexp_matches(name, '^[^/]+/[^/]+$') THEN name
        WHEN contains(bare, '__') AND NOT starts_with(bare, '__') AND NOT (length(bare) = strpos(bare, '__') + 1) THEN left(bare, strpos(bare, '__') - 1) || '/' || bare[strpos(bare, '__') + 2:] END AS model_id
    FROM (SELECT *, regexp_replace(name, '^(details_|results_)', '') AS bare FROM (SELECT p_partkey, {_NAME} AS name FROM part))""")
def model_identity(spark, sf):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("details_"), "p_brand", F.lit("__"), "p_name")).when(k == 1, F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"))).when(k == 2, F.col("p_brand")).otherwise(F.concat(F.lit("results_"), "p_brand", F.lit("__a__b")))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).select("p_partkey", "name", x.file_name(F.col("name")).alias("file"), x.identity(F.col("name")).alias("model_id"))


_PATHS = "SELECT o_custkey % 97 AS repo, 'Run/' || CASE WHEN o_orderkey % 3 = 0 THEN 'ARC' ELSE 'hellaswag' END || '_' || strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S') || CASE WHEN o_orderkey % 5 = 0 THEN '.json' ELSE '.parquet' END AS path FROM orders"


def _paths(spark, sf):
    name = F.when(F.col("o_orderkey") % 3 == 0, "ARC").otherwise("hellaswag")
    end = F.when(F.col("o_orderkey") % 5 == 0, ".json").otherwise(".parquet")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("repo"), F.concat(F.lit("Run/"), name, F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH-mm-ss"), end).alias("path"))


@query("latest_path", f"SELECT repo, max(path) AS path, regexp_extract(max(path), '(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}-\\d{{2}}-\\d{{2}})', 1) AS stamp FROM ({_PATHS}) WHERE contains(lower(path), 'arc') AND path LIKE '%.parquet' GROUP BY repo")
def latest_path(spark, sf):
    return r.latest_path(_paths(spark, sf), "arc").withColumn("stamp", x.timestamp_of(F.col("path")))


@query("deny_list", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY source")
def deny_list(spark, sf):
    kept = r.deny(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 0"), "doc_id")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("match_gold", "SELECT e.event_id, coalesce(a.p_name, b.p_name, c.p_name) AS p_name FROM events e LEFT JOIN part a ON a.p_partkey = e.user_id * 1000 LEFT JOIN part b ON b.p_partkey = e.event_id % 5000 LEFT JOIN part c ON c.p_partkey = e.user_id WHERE coalesce(a.p_name, b.p_name, c.p_name) IS NOT NULL")
def match_gold(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") * 1000).alias("k1"), (F.col("event_id") % 5000).alias("k2"), F.col("user_id").alias("k3"))
    gold = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name")
    return r.match_gold(rows, gold, ["k1", "k2", "k3"]).select("event_id", "p_name")


@query("eligibility", with_obs("""SELECT coalesce(s.model_id, t.model_id) AS model_id, coalesce(s.org_id, t.org_id) AS org_id, coalesce(n0, -1)::BIGINT AS n0, coalesce(n, -1)::BIGINT AS n,
        concat_ws(';', CASE WHEN s.model_id IS NULL THEN 'NO_SOURCE' END, CASE WHEN t.model_id IS NULL THEN 'NO_TARGET' END, CASE WHEN least(n0, n1) < 155 THEN 'SOURCE_HALF_LT155' END, CASE WHEN n < 200 THEN 'TARGET_LT200' END, CASE WHEN s.org_id <> t.org_id THEN 'ORG_MISMATCH' END) AS reasons
    FROM (SELECT model_id, any_value(org_id) AS org_id, count(*) FILTER (half = 0) AS n0, count(*) FILTER (half = 1) AS n1 FROM obs JOIN halves USING (item_id) WHERE model_id::INT % 11 <> 0 GROUP BY 1) s
    FULL JOIN (SELECT model_id, any_value(CASE WHEN model_id::INT % 13 = 0 THEN 'x' ELSE org_id END) AS org_id, count(*) AS n FROM tobs WHERE model_id::INT % 7 <> 0 GROUP BY 1) t USING (model_id)""", HALVES, TARGET))
def eligibility(spark, sf):
    obs = _obs(spark, sf)
    halved = obs.join(descriptors.item_halves(obs), "item_id").where(F.col("model_id").cast("int") % 11 != 0)
    source = halved.groupBy("model_id").agg(F.first("org_id").alias("org_id"), F.count_if(F.col("half") == 0).alias("n0"), F.count_if(F.col("half") == 1).alias("n1"))
    other = _obs(spark, sf, True).where(F.col("model_id").cast("int") % 7 != 0)
    target = other.groupBy("model_id").agg(F.first(F.when(F.col("model_id").cast("int") % 13 == 0, "x").otherwise(F.col("org_id"))).alias("org_id"), F.count("*").alias("n"))
    out = r.eligibility(source, target, 155, 200)
    return out.select("model_id", "org_id", F.coalesce("n0", F.lit(-1)).alias("n0"), F.coalesce("n", F.lit(-1)).alias("n"), "reasons")


@query("paired_models", f"WITH {responses()},\n{observations()},\n{TARGET} SELECT {sql_shown('model_id', 'avg_s AS acc_source; avg_t AS acc_target')} FROM (SELECT model_id, avg(y::INT) AS avg_s FROM obs WHERE model_id::INT % 11 <> 0 GROUP BY 1) JOIN (SELECT model_id, avg(y::INT) AS avg_t FROM tobs GROUP BY 1) USING (model_id)")
def paired_models(spark, sf):
    mean = lambda o, n: o.groupBy("model_id").agg(F.avg(F.col("y").cast("double")).alias(n))
    return shown(mean(_obs(spark, sf).where(F.col("model_id").cast("int") % 11 != 0), "acc_source").join(mean(_obs(spark, sf, True), "acc_target"), "model_id"))


@query("targets", f"""WITH {responses()},\n{TARGET} SELECT {sql_shown('model_id, org_id, n AS n_valid, k AS k_selected', 'rel AS y_cal; sel AS y_sel')} FROM (
        SELECT model_id, org_id, any_value(n) AS n, any_value((n + 1) // 2) AS k, avg(e) FILTER (rn <= (n + 1) // 2) AS sel FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY c DESC, item_id) AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM tobs) GROUP BY ALL)
    JOIN (SELECT model_id, sum(n / t * pow(mc - my, 2)) AS rel FROM (SELECT *, sum(n) OVER (PARTITION BY model_id) AS t FROM (SELECT model_id, least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS mc, avg(y::INT) AS my FROM tobs GROUP BY ALL)) GROUP BY 1) USING (model_id)""")
def targets(spark, sf):
    from tessella.operators.features import score_targets

    return shown(score_targets(_obs(spark, sf, True)))


@query("item_cover", with_obs("SELECT item_id, count(DISTINCT model_id) AS k FROM obs GROUP BY item_id HAVING count(DISTINCT model_id) >= 0.8 * (SELECT count(DISTINCT model_id) FROM obs)"))
def item_cover(spark, sf):
    return r.covered_items(_obs(spark, sf).select("model_id", "item_id"), 0.8).groupBy("item_id").agg(F.countDistinct("model_id").alias("k"))


@query("item_sets", f"""WITH {responses()},\n{TARGET},\na AS (SELECT DISTINCT model_id, item_id FROM resp), b AS (SELECT DISTINCT model_id, item_id FROM tobs)
    SELECT model_id, count(*) AS n_union, count(*) FILTER (x AND y) AS n_both, count(*) FILTER (x AND y IS NULL) AS n_left_only, count(*) FILTER (x IS NULL AND y) AS n_right_only
    FROM (SELECT *, true AS x FROM a) FULL JOIN (SELECT *, true AS y FROM b) USING (model_id, item_id) GROUP BY model_id""")
def item_sets(spark, sf):
    """Of every model, how many items either benchmark has, both have, or one alone."""
    a, b = (rows.select("model_id", "item_id").distinct() for rows in (adapters.responses_from_lineitem(spark, sf), _obs(spark, sf, True)))
    sets = {"n_union": a.union(b).distinct(), "n_both": a.intersect(b), "n_left_only": a.subtract(b), "n_right_only": b.subtract(a)}
    marked = structure.union_all([s.select("model_id", F.lit(name).alias("name")) for name, s in sets.items()])
    return marked.groupBy("model_id").agg(*[F.count_if(F.col("name") == name).alias(name) for name in sets])


@query("fold_union", with_obs("SELECT fold, count(*) AS n FROM (SELECT 'o' || k AS context, k AS fold, org_id FROM members WHERE role = 'scored') GROUP BY fold", MEMBERS))
def fold_union(spark, sf):
    """Scored organisations of all outer folds, each listed once."""
    rows = structure.contexts(_obs(spark, sf)).where("inner IS NULL AND role = 'scored'")
    parts = structure.union_all([rows.where(F.col("outer") == k).select(F.col("outer").cast("long").alias("fold"), "org_id") for k in range(5)])
    return parts.distinct().groupBy("fold").agg(F.count("*").alias("n"))


@query("family_map", "SELECT c_custkey AS model_id, coalesce(f.family, c_custkey::VARCHAR) AS family FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority AS family, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderpriority) AS rn FROM orders) f ON o_custkey = c_custkey AND rn = 1")
def family_map(spark, sf):
    listed = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("model_id"), F.col("o_orderpriority").alias("family"), F.struct("o_orderkey", "o_orderpriority").alias("line"))
    out = r.family_of(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("model_id")), listed)
    return out.select(F.col("model_id").cast("long").alias("model_id"), "family")


@query("metadata_default", "SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN n_chars < 500 THEN '<0.5k' WHEN n_chars < 5000 THEN '0.5-5k' WHEN n_chars IS NULL THEN 'Unknown' ELSE '>=5k' END AS bucket FROM documents LEFT JOIN labels USING (doc_id)")
def metadata_default(spark, sf):
    n = F.col("n_chars")
    bucket = F.when(n < 500, "<0.5k").when(n < 5000, "0.5-5k").when(n.isNull(), "Unknown").otherwise(">=5k")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), bucket.alias("bucket"))


@query("fit_flags", with_obs("SELECT model_id, concat_ws('|', CASE WHEN n < 310 THEN 'few_items' END, CASE WHEN v < 1.5 THEN 'degenerate_lowvar' END, CASE WHEN m < 0 THEN 'neg_mean' END) AS flags FROM (SELECT model_id, count(*) AS n, var_pop(ell) AS v, avg(ell) AS m FROM obs GROUP BY 1)"))
def fit_flags(spark, sf):
    g = _obs(spark, sf).groupBy("model_id").agg(F.count("*").alias("n"), F.var_pop("ell").alias("v"), F.avg("ell").alias("m"))
    return g.select("model_id", r.flags(few_items=F.col("n") < 310, degenerate_lowvar=F.col("v") < 1.5, neg_mean=F.col("m") < 0).alias("flags"))


CAND = "acc AS (SELECT model_id, org_id, avg(y::INT) AS acc, avg(brier) AS brier FROM obs GROUP BY ALL), cand AS (SELECT * FROM (SELECT *, max(acc) OVER (PARTITION BY org_id) AS top, count(*) OVER (PARTITION BY org_id) AS n FROM acc) WHERE n >= 3 AND acc >= top - 0.02::DOUBLE)"


def _accuracy(spark, sf):
    return _obs(spark, sf).groupBy("model_id", "org_id").agg(F.avg(F.col("y").cast("double")).alias("acc"), F.avg("brier").alias("brier"))


@query("candidates", with_obs(f"SELECT {sql_shown('model_id, org_id', 'acc')} FROM cand", CAND))
def candidates(spark, sf):
    return shown(r.candidates(_accuracy(spark, sf)).select("model_id", "org_id", "acc"))


@query("recommendations", with_obs("SELECT org_id, model_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY brier, model_id) AS rn FROM cand) WHERE rn = 1", CAND))
def recommendations(spark, sf):
    return r.pick_lowest(r.candidates(_accuracy(spark, sf)), ["org_id"], "brier", "model_id").select("org_id", "model_id")


@query("extremes", with_obs("SELECT model_id FROM (SELECT *, row_number() OVER (ORDER BY acc DESC, model_id) AS a, row_number() OVER (ORDER BY acc, model_id) AS b FROM acc) WHERE a <= 5 OR b <= 5", CAND))
def extremes(spark, sf):
    acc = _accuracy(spark, sf)
    return acc.orderBy(F.col("acc").desc(), "model_id").limit(5).union(acc.orderBy("acc", "model_id").limit(5)).select("model_id").distinct()


@query("fixed_stride", with_obs("SELECT model_id FROM (SELECT *, row_number() OVER (ORDER BY model_id) - 1 AS i FROM acc) WHERE i IN (SELECT floor(k * ((SELECT count(*) FROM acc) - 1) / 15) FROM range(16) t(k))", CAND))
def fixed_stride(spark, sf):
    return r.fixed_stride(_accuracy(spark, sf), "model_id", 16).select("model_id")


@query("standardised", with_obs(f"SELECT {sql_shown('model_id', '(acc - avg(acc) OVER (PARTITION BY org_id)) / (stddev_pop(acc) OVER (PARTITION BY org_id) + 1e-12::DOUBLE) AS z', 6)} FROM acc", CAND))
def standardised(spark, sf):
    return shown(_accuracy(spark, sf).select("model_id", z_score(["org_id"], "acc").alias("z")), 6)


@query("coverage_counts", with_obs("SELECT count(DISTINCT model_id) AS n_models, count(DISTINCT org_id) AS n_orgs, count(DISTINCT item_id) AS n_items, count(*) AS n_cells, count(DISTINCT least(floor(c * 10), 9)) AS n_bins FROM obs"))
def coverage_counts(spark, sf):
    from tessella.functions.stats import equal_bin

    return _obs(spark, sf).agg(F.countDistinct("model_id").alias("n_models"), F.countDistinct("org_id").alias("n_orgs"), F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_cells"), F.countDistinct(equal_bin("c")).alias("n_bins"))


@query("item_positions", with_obs("SELECT model_id, position::INT AS position, item_id FROM obs JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM (SELECT DISTINCT item_id FROM obs)) USING (item_id)"))
def item_positions(spark, sf):
    obs = _obs(spark, sf)
    order = obs.select("item_id").distinct().withColumn("position", F.row_number().over(Window.orderBy("item_id")) - 1)  # one row an item
    return r.placed(obs.select("model_id", "item_id"), order, "item_id").select("model_id", "position", "item_id")


@query("headline_counts", with_obs(f"SELECT {sql_shown('count(DISTINCT model_id) AS n_models, count(DISTINCT org_id) AS n_orgs, count(DISTINCT least(floor(c * 10), 9)) AS n_bins, (SELECT count(*) FROM halves) AS n_items, (SELECT count(*) FROM halves WHERE half = 0) AS n_first, (SELECT count(*) FROM halves WHERE half = 1) AS n_second', 'min(ell) AS ell_min; max(ell) AS ell_max; min(c) AS c_min; max(c) AS c_max; min(z) AS z_min; max(z) AS z_max')} FROM obs", HALVES))
def headline_counts(spark, sf):
    obs = _obs(spark, sf)
    return shown(report.headline(obs, descriptors.item_halves(obs), ["ell", "c", "z"]))


@query("largest_reference_set", with_obs("SELECT context, ref_key, n_models FROM (SELECT context, sha256(string_agg(org_id, chr(10) ORDER BY org_id)) AS ref_key, sum(n)::BIGINT AS n_models FROM all_members JOIN (SELECT org_id, count(DISTINCT model_id) AS n FROM obs GROUP BY org_id) USING (org_id) WHERE role = 'reference' GROUP BY context) ORDER BY n_models DESC, ref_key, context LIMIT 1", NESTED))
def largest_reference_set(spark, sf):
    obs = _obs(spark, sf)
    return structure.largest_reference_set(obs, structure.contexts(obs))


@query("stage_costs", f"SELECT {sql_shown('event_type AS stage, count(*) AS n', 'sum(value) AS total; max(value) AS peak; quantile_cont(value, 0.25) AS q1; quantile_cont(value, 0.5) AS q2; quantile_cont(value, 0.75) AS q3', 6)} FROM events GROUP BY event_type")
def stage_costs(spark, sf):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"), q.alias("q"))
    return shown(out.select("stage", "n", "total", "peak", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]), 6)


@query("access_rules", with_obs("""SELECT model_id, 'NOT_IN_CONTEXT' AS violation FROM req WHERE model_id NOT IN (SELECT model_id FROM ok)
    UNION ALL SELECT model_id, 'MISSING_FROM_REQUEST' FROM ok WHERE model_id NOT IN (SELECT model_id FROM req)
    UNION ALL SELECT model_id, 'OUTER_TEST_ORG' FROM req WHERE org_id IN (SELECT org_id FROM members WHERE context = 'o0' AND role = 'scored')""", MEMBERS, "models AS (SELECT DISTINCT model_id, org_id FROM obs), ok AS (SELECT model_id, org_id FROM models JOIN members USING (org_id) WHERE context = 'o0' AND role = 'reference'), req AS (SELECT * FROM models WHERE model_id::INT % 9 <> 0)"))
def access_rules(spark, sf):
    valid = items.valid_observations(adapters.responses_from_lineitem(spark, sf), [])
    models = structure.checkpointed(valid.select("model_id", "org_id").distinct())  # a row per model; all that follows reads it
    members = structure.contexts(models).where("context = 'o0'").select("org_id", "role")
    allowed = models.join(members.where("role = 'reference'").select("org_id"), "org_id").select("model_id", "org_id")
    return r.access_violations(models.where(F.col("model_id").cast("int") % 9 != 0), allowed, members.where("role = 'scored'"))


@query("table_difference", with_obs(f"SELECT {sql_shown('model_id, d.col AS \"column\", one_sided', 'd.l AS left_value; d.r AS right_value')} FROM (SELECT coalesce(a.model_id, b.model_id) AS model_id, a.model_id IS NULL OR b.model_id IS NULL AS one_sided, unnest([struct_pack(col := 'acc', l := a.acc, r := b.acc), struct_pack(col := 'brier', l := a.brier, r := b.brier)]) AS d FROM (SELECT * FROM acc WHERE model_id::INT % 10 <> 1) a FULL JOIN (SELECT model_id, acc + CASE WHEN model_id::INT % 6 = 0 THEN 0.5::DOUBLE ELSE 0 END AS acc, brier FROM acc WHERE model_id::INT % 10 <> 2) b USING (model_id)) WHERE one_sided OR abs(d.l - d.r) > 1e-9", CAND))
def table_difference(spark, sf):
    acc = _accuracy(spark, sf)
    m = F.col("model_id").cast("int")
    other = acc.where(m % 10 != 2).withColumn("acc", F.col("acc") + F.when(m % 6 == 0, 0.5).otherwise(0.0))
    out = r.difference(acc.where(m % 10 != 1), other, ["model_id"], ["acc", "brier"], 1e-9)
    return shown(out.withColumnRenamed("left", "left_value").withColumnRenamed("right", "right_value"))


@query("content_hash")
def content_hash(spark, sf):
    return r.content_hash(shown(_accuracy(spark, sf)), ["org_id"])
