"""Every corpus query with SQL equals an independent engine on the same files."""

import glob
import os

import duckdb
import pytest

from tessella.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


def test_repair_sql_knows_the_checksum():
    """The published check value of CRC-32, by the expression that the SQL uses."""
    key = "'123456789'"
    start = queries.ORACLE_SQL["op12_repair"].index("xor(list_reduce(")
    end = queries.ORACLE_SQL["op12_repair"].index(" % 20 AS f FROM k")
    expression = queries.ORACLE_SQL["op12_repair"][start:end].replace("key", key)
    assert duckdb.connect().execute(f"SELECT {expression}").fetchall() == [(0xCBF43926,)]
