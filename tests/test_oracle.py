"""Registered queries against their DuckDB oracle on the smallest test tables."""

import duckdb
import pytest

from tools.oracle_check import TABLES, table_hash

SF = "/root/testdata/sf0.001"
KEYS = ["c02_sentences", "e03_word_counts", "c07_vocabulary", "e05_context_index", "e13_encode_mean",
        "d10_pair_similarity", "e20_word_similarity", "g03_training_split", "f11_sif_weighting", "e23_distillation_loss",
        "a05_word2vec_text_read"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    import __spark_entry__ as E

    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert table_hash(df.columns, rows) == table_hash(ocols, orows)


def test_entry_runs(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.columns == ["pair_id", "sim"] and out.count() >= 0
