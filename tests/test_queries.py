import decimal

import duckdb
import pytest

from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 4) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


#: Neighbouring characters are compared in one pass over Arrow batches: as array functions that took ten times as long.
IN_BATCHES = {"text_likelihood"}


def test_plans_use_no_python(spark):
    for name in registry.QUERIES:
        if not name.startswith("stream_") and name not in IN_BATCHES:
            plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
            assert "Python" not in plan and "MapIn" not in plan, name
