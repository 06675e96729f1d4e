import pytest

import __spark_entry__ as entry
from lexispark.queries import ORACLES, QUERIES
from oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
