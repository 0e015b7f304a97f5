"""The registered queries over `events` rewritten as 8 shuffled files (8 scan tasks,
rows in a different order) still equal the DuckDB oracle on the original file."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from eventlens import registry
from tests.conftest import SF01
from tools.check_oracle import TABLES, digest

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def multi_dir(spark):
    import tempfile

    base = tempfile.mkdtemp(prefix="eventlens-multi-")
    (spark.read.parquet(os.path.join(SF01, "events.parquet"))
     .repartition(8, F.rand(7)).write.parquet(os.path.join(base, "events.parquet")))
    return base


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF01, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_on_many_files_matches_oracle(spark, duck, multi_dir, name):
    df = registry.QUERIES[name](spark, multi_dir)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(registry.ORACLE_SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
