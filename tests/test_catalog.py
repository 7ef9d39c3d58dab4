"""Every registered query of the timed-text operators against its SQL in DuckDB."""

import math
import os
from collections import Counter

import pytest

from cuelight.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "customer documents embeddings events lineitem nation orders pages conversations supplier".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int) and not isinstance(x, bool):
        return float(f"{x:.15g}") if abs(x) < 1e9 else x
    return x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[k]) for k in at) for r in cur.fetchall())


def test_entry_module_without_the_corpus_subpackage(monkeypatch):
    import __spark_entry__ as E

    monkeypatch.setattr(E, "_llm", lambda: None)
    assert set(E.queries()) == set(catalog.queries()) and set(E.oracle_sql()) == set(catalog.oracle_sql())
