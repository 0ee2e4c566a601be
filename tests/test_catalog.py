"""Every query of the catalogue against its DuckDB oracle, and the driver's contract."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from packetlens.plans import catalog, fixtures, oracles

WITHOUT = {"pipeline_full"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in (*fixtures.TABLES, "embeddings"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else round(value, 9) if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, sf, duck, name: str) -> None:
    found = catalog.QUERIES[name](spark, sf)
    wanted = duck.sql(oracles.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.fetchall())


def test_every_other_query_is_known() -> None:
    assert set(catalog.QUERIES) - set(oracles.ORACLES) == WITHOUT


def test_pipeline_full_is_safe(spark, sf) -> None:
    """No approval rests on nothing: every case has a record, and flagged cases aren't approved."""
    found = catalog.QUERIES["pipeline_full"](spark, sf).toPandas()
    assert len(found) == 1500 and found["case_id"].is_unique
    hard = found["risk_flags"].str.contains("active_warrant")
    assert hard.any() and (found.loc[hard, "adjudication"] == "DENIED").all()


def test_entry(spark, sf) -> None:
    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
