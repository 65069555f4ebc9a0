"""Each registered query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([None if pd.isna(v) else v for v in r]) for r in frame.where(frame.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, oracle, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), oracle.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
