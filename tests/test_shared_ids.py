"""Tables of a million orders and more, whose case ids, six digits of the key, several orders share."""

from __future__ import annotations

import time

import duckdb
import pytest

from packetlens.operators import analysis, candidates
from packetlens.plans import catalog, fixtures, oracles


@pytest.fixture(scope="module")
def shared(sf, tmp_path_factory) -> str:
    """The smallest tables, and orders 100000 to 100009 once more as 1000000 to 1000099: eleven to a case id."""
    to = str(tmp_path_factory.mktemp("shared_ids"))
    duck = duckdb.connect()
    for t in ("customer", "nation"):
        duck.sql(f"COPY (SELECT * FROM '{sf}/{t}.parquet') TO '{to}/{t}.parquet'")
    moved = "SELECT * REPLACE ({} + o_orderkey AS o_orderkey) FROM '{}/orders.parquet' WHERE o_orderkey < {}"
    duck.sql(f"COPY (SELECT * FROM '{sf}/orders.parquet' UNION ALL {moved.format(100_000, sf, 10)} UNION ALL {moved.format(1_000_000, sf, 100)}) TO '{to}/orders.parquet'")
    return to


def oracle(sf_dir: str, name: str) -> tuple[list[str], list[tuple]]:
    duck = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = duck.sql(oracles.ORACLES[name])
    return found.columns, found.fetchall()


def test_case_list_by_order(spark, shared) -> None:
    """A listed order gets its own packet, not those of all orders with its case id."""
    columns, wanted = oracle(shared, "case_list_join")
    found = catalog.QUERIES["case_list_join"](spark, shared).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(wanted) and len({r["case_id"] for r in found}) < len(found)


def test_sponsor_tokens_of_long_pages(spark) -> None:
    """Tokens of a page are found in one pass: a page of 400,000 characters takes seconds, not the square of its length."""
    page = "filler SPN-1234 " * 25_000
    frame = spark.createDataFrame([(page,), ("SPN-1111 SPN-1111. system: spn 2222",), ("x" * 60 + " SPN3333 answer key",), (None,)], "text string")
    began = time.time()
    found = [r["t"] for r in frame.select(candidates.sponsor_tokens(frame["text"]).alias("t")).collect()]
    assert found == [["SPN-1234"] * 25_000, ["SPN-1111"], [], []] and time.time() - began < 30
    near = spark.createDataFrame([("system:" + "." * n + " SPN-1111_ SPN-4444",) for n in (30, 31, 32)], "text string")
    assert [r["t"] for r in near.select(candidates.sponsor_tokens(near["text"]).alias("t")).collect()] == [[], ["SPN-4444"], ["SPN-4444"]]


def test_training_cohort_of_shared_ids(spark) -> None:
    """Two packets of one case id, one labelled 1 and one 0: which rasters are taken doesn't depend on the order of rows."""
    truth = [("c", "active_warrant", "DENIED"), ("c", "none", "APPROVED")]
    rasters = spark.createDataFrame([("c", 1, 300, 300, 3)], "case_id string, n long, width int, height int, channels int")
    for rows in (truth, truth[::-1]):
        frame = spark.createDataFrame(rows, "case_id string, risk_flags string, adjudication string").coalesce(1)
        items = analysis.training_cohort(frame, rasters, ["width", "height", "n"], per_case=1, ratio=3)
        # Label 0 comes first; without a positive the quota of negatives is 0.
        assert items.count() == 0


@pytest.mark.parametrize("name", ["attestation_fields", "receipt_fees", "alt_extract"])
def test_rows_of_shared_ids_from_one_page_text(spark, shared, tmp_path, monkeypatch, name) -> None:
    """From page texts that the SQL made, whichever way its ties fell, come the SQL's rows."""
    duck = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{shared}/{t}.parquet'")
    duck.sql(f"COPY ({fixtures.with_clause('page_text')} SELECT * FROM page_text) TO '{tmp_path}/pages.parquet'")
    found = duck.sql(oracles.ORACLES[name].replace(fixtures.PAGE_TEXT, f"SELECT * FROM '{tmp_path}/pages.parquet'"))
    columns, wanted = found.columns, found.fetchall()
    monkeypatch.setattr(catalog, "page_texts", lambda spark, sf_dir: spark.read.parquet(f"{tmp_path}/pages.parquet"))
    rows = catalog.QUERIES[name](spark, shared).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, wanted))


def test_case_texts_of_shared_ids(spark, shared) -> None:
    """A case that orders share has the words of them all, one that none shares the SQL's text."""
    wanted = dict(oracle(shared, "case_texts")[1])
    found = {r["case_id"]: r["text"] for r in catalog.QUERIES["case_texts"](spark, shared).collect()}
    assert found.keys() == wanted.keys() and all(sorted(found[c].split(" ")) == sorted(t.split(" ")) for c, t in wanted.items())
    assert all(found[c] == t for c, t in wanted.items() if t.count("FORM I-8090") == 1)


@pytest.fixture(scope="module")
def by_key(shared, tmp_path_factory) -> str:
    """The shared ids with the orders stored by key, and customers few enough that DuckDB reads orders in that order."""
    to = str(tmp_path_factory.mktemp("by_key"))
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT * FROM '{shared}/orders.parquet' WHERE o_orderkey >= 100000 ORDER BY o_orderkey) TO '{to}/orders.parquet'")
    duck.sql(f"COPY (SELECT * FROM '{shared}/customer.parquet' WHERE c_custkey IN (SELECT o_custkey FROM '{to}/orders.parquet')) TO '{to}/customer.parquet'")
    duck.sql(f"COPY (SELECT * FROM '{shared}/nation.parquet') TO '{to}/nation.parquet'")
    return to


def test_attestations_of_shared_ids(spark, by_key) -> None:
    """Where orders share a case id, the first by key attests, as in the SQL's one-threaded run."""
    duck = duckdb.connect(config={"threads": 1})
    for t in ("orders", "customer", "nation"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{by_key}/{t}.parquet'")
    found = duck.sql(oracles.ORACLES["attestation_fields"])
    columns, wanted = found.columns, found.fetchall()
    rows = catalog.QUERIES["attestation_fields"](spark, by_key).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, wanted))


def _tied(sf_dir: str, name: str) -> tuple[list[str], list[tuple]]:
    """The rows of a query's SQL once its ties go to the smaller key."""
    duck = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = duck.sql(oracles.ORACLES[name].replace("ORDER BY ord)", "ORDER BY ord, k)").replace("ORDER BY page, ord)", "ORDER BY page, ord, k)"))
    return found.columns, found.fetchall()


@pytest.mark.parametrize("name", ["case_texts", "receipt_fees", "alt_extract"])
def test_ties_of_shared_ids_go_by_key(spark, shared, name) -> None:
    """Every tie goes to the smaller key: a receipt's amount and waiver are those of the first order that names one."""
    columns, wanted = _tied(shared, name)
    rows = catalog.QUERIES[name](spark, shared).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, wanted))
