"""Every registered query against its SQL counterpart."""

from collections import Counter

import pytest

import __spark_entry__ as contract

from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES


def test_each_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(row[c] for c in columns)) for row in df.collect())
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = Counter(repr(tuple(row[i] for i in at)) for row in result.fetchall())
        assert got == want


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
