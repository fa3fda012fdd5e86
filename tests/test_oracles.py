"""Every query against its SQL equivalent: columns, types, rows and values."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from threadmill.testing.oracles import ORACLES
from threadmill.testing.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(ORACLES) == {"file_catalog"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(name, spark, duck, sf_dir):
    ours = queries()[name](spark, sf_dir)
    theirs = duck.sql(oracle_sql()[name])
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    their_types = {c: str(t) for c, t in zip(theirs.columns, theirs.types)}
    assert {c: TYPES[t] for c, t in ours.dtypes} == their_types
    expected = theirs.select(*columns).fetchall()
    got = [tuple(r) for r in ours.select(*columns).collect()]
    assert len(got) == len(expected)
    missing, extra = Counter(expected) - Counter(got), Counter(got) - Counter(expected)
    assert not missing and not extra, (list(missing)[:3], list(extra)[:3])
