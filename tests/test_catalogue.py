import pytest

from tarnweave.plans import catalogue
from tests.conftest import DATA
from tests.oracle import same, tables


@pytest.fixture(scope="module")
def con():
    return tables(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, DATA), con, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_words_behind_a_nul_are_counted(spark, tmp_path):
    spark.createDataFrame([(1, "a b\x00c d"), (2, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["key"]: r["n"] for r in catalogue.flat_map_to_pair(spark, str(tmp_path)).collect()}
    assert got == {"a": 1, "b\x00c": 1, "d": 2}
