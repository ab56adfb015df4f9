import datetime
import decimal
import sys

import duckdb
import pytest

import __spark_entry__ as e
import wardline
from wardline import queries
from wardline.sources.relations import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in (*TABLES, "region"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", queries.QUERIES)
def test_equals_duckdb(spark, db, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = db.execute(queries.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda r: str([float(x) if isinstance(x, decimal.Decimal) else str(x) if isinstance(x, datetime.date) else x for x in r])
    assert sorted(map(plain, got.select(*names).collect())) == sorted(map(plain, rows.fetchall()))


def test_entry(spark):
    assert len(e.entry(spark).collect()) > 0
    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.SQL) == set(queries.QUERIES)


@pytest.mark.parametrize("missing", ["wardline.llm", "wardline.llm.queries", "pyarrow.compute"])
def test_entry_without_the_llm_folder(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith("wardline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(wardline, "llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)  # its import fails
    with pytest.warns(UserWarning, match="no training-data queries"):
        assert set(e.queries()) == set(queries.QUERIES) and set(e.oracle_sql()) == set(queries.SQL)
