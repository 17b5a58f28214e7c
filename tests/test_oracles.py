"""Every query with SQL gives the rows that SQL gives, on the smallest tables."""

import numbers
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    def value(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        return round(float(x), 6) if isinstance(x, (numbers.Number, Decimal)) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(value(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
