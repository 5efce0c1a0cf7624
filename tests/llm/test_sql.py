"""Queries that SQL can express, against DuckDB on the driver's smallest tables."""

import duckdb
import pandas as pd
import pytest

from vellum.llm import queries, sql

TABLES = ("documents", "pages", "labels", "benchmark", "conversations")


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(str([None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(sql.ORACLE_SQL[name]).fetchdf())
