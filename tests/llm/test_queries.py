import duckdb
import pytest

import __spark_entry__ as e
from wardline.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations", "labels", "embeddings")


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in rows.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, rows.fetchall()))


def test_every_operator_is_registered():
    found = e.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k[: k.index("_") + 1] for k in found if k.startswith("op")} and "pipeline" in found
    assert set(queries.ORACLE_SQL) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    assert "doc_id" in got.columns and (got.count() == 200 or name.startswith("op4"))
