"""Captures written from rows and read back: every decoder, view, stream table and tool against SQL."""

from __future__ import annotations

import duckdb
import pytest

from wirelake.plans import roundtrip

KEYS = range(1, 400)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("orders")
    spark.createDataFrame([(k,) for k in KEYS] + [(65536 + k,) for k in range(64)], "o_orderkey long").coalesce(1).write.parquet(f"{d}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet/*.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", roundtrip.QUERIES)
def test_round_trip(spark, orders, name):
    d, con = orders
    df = roundtrip.QUERIES[name](spark, d)
    rel = con.sql(roundtrip.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    theirs = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    columns = sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[c] for c in columns) for r in theirs), key=repr) and theirs


def test_every_view_and_decoder_has_one():
    from wirelake import schema
    from wirelake.plans.views import VIEWS

    assert set(roundtrip.VIEWED) == {v.name for v in VIEWS} and set(roundtrip.DECODED) == set(schema.PROTOCOLS) - {"http", "http2"}
