"""Every registered query on the smallest tables, against its SQL where it has one."""

import os

import pytest

SF = "/root/testdata/sf0.001"
#: Listings that the smallest tables have no row for; they are compared on larger ones.
EMPTY_HERE = {"near_dup_list", "page_name_overlap"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["lang", "n", "threshold", "k", "rate", "ci_low", "ci_high"]


@pytest.mark.parametrize("module", ["pairs", "rates", "splits", "metrics", "statistics", "vectors", "projections", "checking"])
def test_queries_equal_their_sql(spark, module):
    import importlib

    from tools.compare import connect, differences

    loaded = importlib.import_module(f"leaksift.queries.{module}")
    con, bad = connect(SF), {}
    for name, query in loaded.QUERIES.items():
        df = query(spark, SF)
        if name not in loaded.SQL:
            assert df.count(), name
            continue
        found = differences(df, con, loaded.SQL[name])
        if found and not (name in EMPTY_HERE and found == "no rows on either side"):
            bad[name] = found
    assert not bad


def test_kept_tables_follow_their_files(spark, tmp_path):
    from leaksift.queries.base import kept

    path = str(tmp_path / "t.parquet")
    build = lambda: spark.read.parquet(path)
    spark.range(3).write.parquet(path)
    assert kept(spark, str(tmp_path), "t", build).count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert kept(spark, str(tmp_path), "t", build).count() == 5
