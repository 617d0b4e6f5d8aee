"""Rows that only larger tables have: captures of one ticker at one time, of which the last has one side alone."""

import duckdb
import pytest
from test_oracle import plain

from skyledger import catalog


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Events of two users; ids that a hundred divides give books without a yes side."""
    path = str(tmp_path_factory.mktemp("tied"))
    rows = [(i, f"2024-01-{5 + i % 3:02d} 08:00:00", u, "view", 7.5, "") for u in (1, 2) for i in (101 + u, 200 + u - u % 2, 300, 433 + u)]
    con = duckdb.connect()
    values = ", ".join(f"({i}, TIMESTAMP '{ts}', {u}, '{k}', {v}, '{p}')" for i, ts, u, k, v, p in rows + [(500, "2024-01-06 08:00:00", 1, "view", 1.5, ""), (497, "2024-01-06 08:00:00", 1, "view", 1.5, "")])
    con.sql(f"copy (select CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, d AS event_type, CAST(e AS DOUBLE) AS value, f AS props from (values {values}) v(a, b, c, d, e, f)) to '{path}/events.parquet'")
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["agg_depth", "jn_asofb", "agg_dmed", "agg_dmed_week"])
def test_the_last_capture_with_both_sides(spark, tied, name):
    path, con = tied
    got, want = catalog.QUERIES[name](spark, path), con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    a = sorted(tuple(plain(row[c]) for c in columns) for row in got.collect())
    b = sorted(tuple(plain(row[want.columns.index(c)]) for c in columns) for row in want.fetchall())
    assert a == b and b
