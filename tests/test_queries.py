"""Every query with an oracle, held against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from clauseflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(sorted(df.columns), axis=1)

    def one(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.6g}"
        return "null" if v is None or v is pd.NaT or v is pd.NA else str(v)

    return sorted(tuple(map(one, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    mine, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(want.columns)
    assert plain(mine) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert len(registry.queries()[name](spark, SF).columns) > 0
