"""Every query that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from weft import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert cols == sorted(names)
    assert rows == sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def test_first_of_equal_lines(spark, tmp_path):
    """The first row of the first file stands for a line, however rows and files are read."""
    con, folder = duckdb.connect(), tmp_path / "lineitem.parquet"
    folder.mkdir()
    made = "SELECT r % 500 AS l_orderkey, (r % 3 + 1)::INT AS l_linenumber, nullif('F' || {} || '-' || r, 'F0-4') AS l_returnflag FROM range({}) t(r)"
    for k, n in enumerate((20_000, 2_000, 30_000)):
        con.execute(f"COPY ({made.format(k, n)}) TO '{folder}/part-{k}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {(r.l_orderkey, r.i): r.f for r in queries.QUERIES["a02_arrays_with_holes"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(o, 0): None for o in range(500)}
    for r in range(20_000):
        want.setdefault((r % 500, r % 3 + 1), None if r == 4 else f"F0-{r}")
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
