"""Every registered query equals its DuckDB oracle at sf0.01 (rows, columns, values)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from eventlens import registry
from eventlens.plans.inspect import python_evals
from tests.conftest import SF001, SF01
from tools.check_oracle import TABLES, digest

QUERIES = registry.QUERIES
DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}
ORACLE = registry.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF01, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF01)
    # Only the opt-in facet pre-limit runs Python (Arrow batches inside tasks).
    assert python_evals(df) == (1 if name.endswith("_prelimit") else 0)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
    spark_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = dict(zip(ocols, [str(t) for t in duck.sql(ORACLE[name]).types]))
    assert spark_types == duck_types


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["bucket", "bucket_ms", "series", "is_other", "series_rank", "event_count"]
    assert len(rows) > 0
    assert E.entry(spark).schema == df.schema
    assert os.path.isdir(SF001)
