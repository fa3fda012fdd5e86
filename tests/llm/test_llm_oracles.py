"""The queries that SQL can express against their SQL: columns, types, rows and values."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from threadmill.llm.oracles import ORACLES
from threadmill.llm.queries import QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    their_types = {c: str(t) for c, t in zip(theirs.columns, theirs.types)}
    assert {c: TYPES[t] for c, t in ours.dtypes} == their_types
    expected = Counter(theirs.select(*columns).fetchall())
    got = Counter(tuple(r) for r in ours.select(*columns).collect())
    missing, extra = expected - got, got - expected
    assert not missing and not extra, (list(missing)[:3], list(extra)[:3])
