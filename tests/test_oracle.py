"""Every core query with SQL gives the same rows as DuckDB; all core queries run."""

import pytest

import __spark_entry__ as entry
from tests.oracle import canon, connect
from tracewell.plans import corpus, evidence, reports, runs, sessions, views

MODULES = (corpus, sessions, evidence, reports, runs, views)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLE = {n: q for m in MODULES for n, q in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE:
        want = connect(sf_dir).execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
