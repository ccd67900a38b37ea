"""Every registered query against its check SQL, on the smallest data set."""

import datetime
import os

import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: (round(v, 5) if isinstance(v, float) else
                      v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def test_every_sql_key_is_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, df.collect())
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == canonical(columns, result.fetchall())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and {"pair_id", "generated", "status"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", ["edit_script", "apply_edits", "vocabulary", "effort_at_recall"])
def test_partition_count_does_not_matter(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = QUERIES[name](spark, SF)
            results.append(canonical(df.columns, df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
