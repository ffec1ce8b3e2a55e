"""Every query of the engine against the SQL that DuckDB runs over the same tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from assayer import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def canonical(df):
    def cell(v):
        return "null" if pd.isna(v) else f"{float(v):.12g}" if isinstance(v, (float, int, np.integer)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_oracle_has_rows(spark, sf, name):
    """What the rows must be is held against brute force in test_evidence.py."""
    rows = QUERIES[name](spark, sf)
    assert rows.count() > 0 and len(set(map(str.lower, rows.columns))) == len(rows.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_folded_keys_read_whole_texts(spark, tmp_path):
    texts = ["a" * 300 + " one", "a" * 300 + " two", "A" * 300 + "  ONE"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = {r["doc_id"]: r["key"] for r in QUERIES["folded_keys"](spark, str(tmp_path)).collect()}
    assert key[0] != key[1]


def test_evidence_gate_on_letters_beyond_ascii_and_null_texts(spark, tmp_path):
    """A negation beside a letter beyond ASCII counts, as in the SQL's \\b; a null text has no polarity."""
    texts = {1: "noítaga cimita", 2: "éno", 3: "le chatnon", 4: "uñnot_", 6: None, 7: "not here"}
    rows = [(conv, turn, "user", said) for conv, text in texts.items() for turn, said in ((0, "plain"), (2, text))]
    rows += [(9, 0, "user", None), (9, 2, "user", "not here")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = QUERIES["evidence_gate"](spark, str(tmp_path)).toPandas(), c.sql(SQL["evidence_gate"]).df()
    assert canonical(got) == canonical(want) and set(want[want["needs_review"]]["query_id"]) == {1, 2, 7}


def test_inventory_recall_explodes_no_row_that_carries_its_tokens(spark, sf):
    """A token's row holds the token alone, not the text's whole list beside it."""
    plan = QUERIES["inventory_recall"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.splitlines() if "Generate explode(c#" in line]
    assert exploded and all("), [2], " in line for line in exploded)
