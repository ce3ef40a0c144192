"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from tests_data import SMALL, TABLES

from shelfspark.plans import catalog, catalog_engine, catalog_more, catalog_resolution, catalog_upkeep  # noqa: F401


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        if isinstance(x, bool) or str(type(x)).endswith("bool_'>") or str(type(x)).endswith("numpy.bool'>"):
            return bool(x)
        try:
            return round(float(x), 6)
        except (TypeError, ValueError):
            return str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(plain, r))) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalog.ORACLE:
        assert len(got)
        return
    want = duck.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
