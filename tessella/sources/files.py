"""Readers and sinks of the file formats at the edges: CSV, JSON lines, order files, array archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With header and declared types; a malformed row is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, drop_malformed: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_malformed else "FAILFAST").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Event and audit logs: only ever appended to."""
    df.write.mode("append").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, compressed or not."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """``line, id`` of an order file: stripped lines without blanks and comments; a repeated id is an error.

    ``line`` rises with the file's lines but leaves gaps.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("id"))
    rows = rows.where("id <> '' AND NOT startswith(id, '#')")
    times = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return times.select("line", F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated id in an order file: "), "id"))).alias("id"))


def read_archives(spark: SparkSession, path: str, arrays: list[str]) -> DataFrame:
    """``path, name, row, value``: the named numeric arrays of NPZ files, a row per entry along the first axis.

    Only the named arrays are decoded; temporary files (``*.tmp.npz``) are left out; non-finite entries are null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).where("NOT endswith(path, '.tmp.npz')").select("path", "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for key in arrays:
                        a = np.atleast_1d(np.lib.format.read_array(io.BytesIO(z.read(f"{key}.npy")), allow_pickle=False)).astype(float)
                        values = [[x if np.isfinite(x) else None for x in row] for row in a.reshape(len(a), -1).tolist()]
                        yield pd.DataFrame({"path": name, "name": key, "row": range(len(a)), "value": values})

    return files.mapInPandas(decode, "path string, name string, row long, value array<double>")


def read_drifting(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files whose columns differ, with nulls for what a file lacks."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def synthetic_responses(spark: SparkSession, n_models: int, n_items: int, seed: int = 0, phi: float = 10.0) -> DataFrame:
    """``model_id, item_id, c, y, tok_len`` drawn from the joint two-trait model; each cell's draw follows its own seed."""
    cells = spark.range(n_models * n_items).select((F.col("id") / n_items).cast("int").alias("m"), (F.col("id") % n_items).cast("int").alias("i"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        theta_a, theta_c, gamma = rng.normal(size=n_models), rng.normal(size=n_models) * 0.7, rng.normal(size=n_models) * 0.2
        a, b, alpha, z, length = rng.uniform(0.7, 1.8, n_items), rng.normal(size=n_items), rng.uniform(0.5, 1.2, n_items), rng.normal(size=n_items) * 0.3, rng.uniform(1, 4, n_items)
        for f in frames:
            m, i = f["m"].to_numpy(), f["i"].to_numpy()
            own = [np.random.default_rng([seed, x, y]) for x, y in zip(m.tolist(), i.tolist())]
            p = 1 / (1 + np.exp(-a[i] * (theta_a[m] - b[i])))
            mu = 1 / (1 + np.exp(-(alpha[i] * (theta_a[m] + theta_c[m] + z[i]) + gamma[m] * (length[i] - length.mean()))))
            c = np.array([float(g.random() < q) for g, q in zip(own, p)])
            y = np.clip([g.beta(q * phi, (1 - q) * phi) for g, q in zip(own, mu)], 1e-6, 1 - 1e-6)
            yield pd.DataFrame({"model_id": [f"m{x:05d}" for x in m], "item_id": [f"i{x:05d}" for x in i], "c": c, "y": y, "tok_len": length[i]})

    return cells.mapInPandas(draw, "model_id string, item_id string, c double, y double, tok_len double")
