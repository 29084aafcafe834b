"""Queries against DuckDB on the smallest tables, and invariants of the chunks."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quire.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "customer part nation lineitem orders documents conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda v: None if v is None or pd.isna(v) else str(float(v)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)
    return sorted(str([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_ghost_spaces_whole_texts(spark, tmp_path):
    texts = ["word " * 30 + "end", "a\tb \r\n c\fd" + "  x" * 40, "é😀 " * 50, "short", "", " \n ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["line_id"]: r["text"] for r in QUERIES["ghost_space_rebuild"](spark, str(tmp_path)).collect()}
    assert got == {k: " ".join(t.split()) for k, t in enumerate(texts) if t is not None}


def test_ghost_spaces_of_whole_lines_need_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Exchange" not in QUERIES["ghost_space_rebuild"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_chunk_invariants(spark):
    c = entry.entry(spark).toPandas()
    assert c.chunk_id.is_unique and (c.est_tokens <= 512).all() and (c.text != "").all()
    by = c.set_index("chunk_id")
    for i, r in by.iterrows():
        if r.next_chunk_id:
            assert by.loc[r.next_chunk_id].prev_chunk_id == i
    assert (c[c.section_path != ""].apply(lambda r: r.text.startswith(r.section_path), axis=1)).all()


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
