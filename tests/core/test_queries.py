import os

import duckdb
import pandas as pd
import pytest

from ledgerlens.operators import join_queries, run_queries  # noqa: F401
from ledgerlens.operators.queries import QUERIES, SQL
from ledgerlens.plans import composed as composed_queries  # noqa: F401
from ledgerlens.plans import queries as plan_queries  # noqa: F401
from ledgerlens.streaming import queries as stream_queries  # noqa: F401

DATA = os.environ.get("LEDGER_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def rows(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda x: str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else None if pd.isna(x) else round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(repr, map(value, r))) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, oracle, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_module_registers_everything():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
