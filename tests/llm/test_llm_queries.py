import os

import pytest

from skerry.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    from tests.oracle import agrees

    agrees(spark, FOLDER, queries.queries()[name], queries.oracle_sql().get(name))


def test_no_ngram_is_left_out(spark):
    every = queries.p1_ngram_bands(spark, FOLDER).select("ngram", "n", "occurrences", "records", "band").collect()
    assert {r["n"] for r in every if r["records"] == 1} == {1, 2, 3}
    assert {r["band"] for r in every if r["records"] <= 2} == {"rare"} and {r["band"] for r in every} >= {"rare", "useful"}
    assert sorted(tuple(r)[:4] for r in every) == sorted(tuple(r) for r in queries.p1_ngrams(spark, FOLDER).collect())
