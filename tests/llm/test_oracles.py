"""Queries of the subpackage against their SQL in DuckDB."""

import duckdb
import pytest

from assetlens.llm.queries import ORACLE_SQL, QUERIES

TABLES = ["documents", "embeddings", "pages", "labels"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(tuple(map(str, r)) for r in got.select(columns).collect()) == want
