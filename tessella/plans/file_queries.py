"""Registered queries that write tables in the formats at the edges and read them back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessella.plans.descriptor_queries import shown, sql_shown
from tessella.sources import archives, files
from tessella.sources.adapters import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def _path(spark, name: str) -> str:
    """A fresh folder where all executors can write."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not (conf.get("spark.master", "") or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", f"SELECT {sql_shown('c_custkey, c_name, c_nationkey, c_mktsegment', 'c_acctbal')} FROM customer")
def csv_round_trip(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    path = _path(spark, "csv")
    files.write_csv(rows, path)
    return shown(files.read_csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"))


@query("json_lines_round_trip", f"SELECT {sql_shown('event_type, count(*) AS n, count(DISTINCT user_id) AS users', 'sum(value) AS value', 5)} FROM events GROUP BY event_type")
def json_lines_round_trip(spark, sf):
    """Two appends to one log, then a batch read."""
    rows, path = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), _path(spark, "jsonl")
    files.append_json_lines(rows.where("event_id % 2 = 0"), path)
    files.append_json_lines(rows.where("event_id % 2 = 1"), path)
    back = files.read_json_lines(spark, path, "event_id long, user_id long, event_type string, value double")
    return shown(back.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum("value").alias("value")), 5)


@query("order_file", "SELECT DISTINCT p_brand AS id FROM part")
def order_file(spark, sf):
    brands, path = table(spark, sf, "part").select("p_brand").distinct(), _path(spark, "order")
    lines = brands.select(F.explode(F.array(F.concat(F.lit("  "), "p_brand", F.lit("  ")), F.lit(""), F.concat(F.lit("# "), "p_brand"))).alias("value"))
    lines.write.text(path)
    return files.read_order(spark, path).select("id")


@query("drifting_schemas", "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey ELSE -1 END AS region FROM nation")
def drifting_schemas(spark, sf):
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    wide, narrow = _path(spark, "wide"), _path(spark, "narrow")
    rows.where("id % 2 = 0").write.parquet(wide)
    rows.where("id % 2 = 1").drop("region").write.parquet(narrow)
    return files.read_drifting(spark, [wide, narrow]).withColumn("region", F.coalesce("region", F.lit(-1)))


def _archives(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("double").alias("vec_id"), F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    path = _path(spark, "npz")
    archives.write(rows, path, {"kind": "vectors"}, block=500)
    return path


@query("archive_scan", f"SELECT {sql_shown('vec_id::BIGINT AS vec_id, len(embedding)::BIGINT AS dims', 'label::DOUBLE AS label; list_sum(embedding::DOUBLE[]) AS total; list_max(embedding::DOUBLE[]) AS top', 6)} FROM embeddings")
def archive_scan(spark, sf):
    """All vectors written as archives and read back by member, rows of one archive put together by place."""
    rows = archives.scan(spark, _archives(spark, sf), ["vec_id", "label", "embedding"])
    at = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    back = rows.groupBy("path", "row").agg(at("vec_id")[0].cast("long").alias("vec_id"), at("label")[0].alias("label"), at("embedding").alias("v"))
    return shown(back.select("vec_id", F.size("v").cast("long").alias("dims"), "label", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_max("v").alias("top")), 6)


@query("archive_headers", "SELECT name, 1 + (name = 'embedding')::INT AS axes, CASE WHEN name = 'embedding' THEN max(len(embedding)) ELSE 1 END::BIGINT AS width, count(*) AS n FROM embeddings, (SELECT unnest(['vec_id', 'label', 'embedding']) AS name) GROUP BY 1")
def archive_headers(spark, sf):
    """Sizes of all arrays from their headers alone."""
    rows = archives.headers(spark, _archives(spark, sf)).where("scalar IS NULL")
    return rows.groupBy("name", F.size("shape").alias("axes"), F.coalesce(F.get("shape", F.lit(1)), F.lit(1)).alias("width")).agg(F.sum(F.get("shape", F.lit(0))).alias("n"))
