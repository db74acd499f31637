import os

import pytest

from skerry import catalog
from tests.oracle import agrees

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    agrees(spark, FOLDER, catalog.queries()[name], catalog.oracle_sql().get(name))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_ledger_plans_exactly_the_open_entries(spark, monkeypatch):
    from skerry.operators import incremental, queries

    plans = []
    plan = incremental.Ledger.plan
    monkeypatch.setattr(incremental.Ledger, "plan", lambda self, *a: plans.append(self) or plan(self, *a))
    items = queries.p6_work(spark, FOLDER).collect()
    entries = sorted((r["index_name"], r["sequence_number"]) for r in plans[0].planned().collect())
    assert entries == sorted(tuple(r) for r in queries.p6_found(spark, FOLDER).collect())
    assert len(entries) == len(set(entries)) == sum(r["entries"] for r in items)
