"""The registered queries that SQL can express, against it, and the columns of the others."""

import duckdb
import pytest

import __spark_entry__ as entry
from eventlens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.data import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op3_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_simhash": "doc_id fingerprint component_id",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = entry.queries()[name](spark, SMALL)
    assert got.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    assert got.count() == 200
