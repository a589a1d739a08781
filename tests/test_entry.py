import __spark_entry__ as entry
from nearfield.plans.queries import ORACLES, QUERIES


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["q_id", "rank", "vec_id", "dist"] and df.count() == 5000


def test_every_query_is_registered_with_its_sql():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
