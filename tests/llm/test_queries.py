"""Registered queries of this subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from trawl.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op4_exact_dedup"}))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(columns).collect())


def test_quotes_are_linked(con):
    """The conversations of chat_format_quotes have links of both levels, and replies to replies."""
    found = con.sql(f"SELECT sum(n_linked), sum(n_quotes - n_linked), max(depth) FROM ({SQL['chat_format_quotes']})").fetchall()[0]
    assert found[0] > 20 and found[1] > 0 and found[2] >= 2
