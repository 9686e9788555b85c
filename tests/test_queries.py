"""Every query against the same result in SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from casewright.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool | str):
        return x
    if isinstance(x, float):
        return round(x, 6)
    return int(x) if hasattr(x, "__int__") and not hasattr(x, "strftime") else x


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def test_boosted_trees_beat_a_constant(spark, sf_dir):
    rows = QUERIES["boosted_predictions"](spark, sf_dir).toPandas()
    assert len(rows) and (rows["prediction"] >= 0).all() and (rows["prediction"] - rows["y"]).abs().mean() < rows["y"].abs().mean()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


