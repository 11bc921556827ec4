"""Every registered query of the core runs; those with SQL equal an independent engine on the same files."""

import glob
import os

import duckdb
import numpy as np
import pytest

from tessella.plans import registry
from tessella.sources import files


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def canonical(df, columns):
    def text(v):
        if v is None or v is np.nan or (isinstance(v, float) and np.isnan(v)):
            return "-"
        return str(round(float(v), 6)) if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, engine, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), engine.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(got, columns) == canonical(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    assert got.columns and all(len(r) == len(got.columns) for r in got.collect())


def test_archives_are_read_by_name(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.array([[1.0, np.nan], [3.0, 4.0]]), y=np.arange(3), z=np.array(["no"]))
    np.savez(tmp_path / "b.tmp.npz", x=np.zeros(9))
    got = [(r["name"], r["row"], r["value"]) for r in files.read_archives(spark, str(tmp_path), ["x", "y"]).orderBy("name", "row").collect()]
    assert got == [("x", 0, [1.0, None]), ("x", 1, [3.0, 4.0]), ("y", 0, [0.0]), ("y", 1, [1.0]), ("y", 2, [2.0])]


def test_a_repeated_id_in_an_order_file_is_an_error(spark, tmp_path):
    path = tmp_path / "order.txt"
    path.write_text("a\n\n# note\n b \na\n")
    with pytest.raises(Exception, match="repeated id"):
        files.read_order(spark, str(path)).collect()


def test_malformed_lines_are_dropped_only_on_request(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert files.read_json_lines(spark, str(path), "a long", drop_malformed=True).where("a IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(path), "a long").collect()


def test_entry_works_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
