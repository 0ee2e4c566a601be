"""Positions, slices, and readers that reject."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from packetlens import lineage
from packetlens.functions import vocab as V
from packetlens.operators import analysis, driver, positions
from packetlens.sources import checked, readers


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_case_list_in_many_splits(spark, tmp_path) -> None:
    names = [f"C{i:05d}" if i % 7 else ("" if i % 2 else "  ") for i in range(5000)]
    (tmp_path / "list.txt").write_text("\n".join(names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        listed = readers.case_list(spark, str(tmp_path / "list.txt"))
        found = [(r["pos"], r["case_id"]) for r in listed.orderBy("pos").collect()]
        assert listed.rdd.getNumPartitions() > 4 and "SinglePartition" not in plan(listed) and "Window" not in plan(listed)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == list(enumerate(n for n in names if n.strip()))
    (tmp_path / "empty.txt").write_text("\n \n")
    assert readers.case_list(spark, str(tmp_path / "empty.txt")).count() == 0


@pytest.mark.parametrize(("start", "limit"), [(0, 3), (0, None), (10, 25), (95, 50), (97, None), (200, 5), (40, 0)])
def test_slices(spark, start, limit) -> None:
    ids = random.Random(2).sample(range(1000), 97)
    rows = spark.createDataFrame([(f"C{i:03d}", i) for i in ids], "case_id string, v int").repartition(5)
    found = driver.take_slice(rows, start, limit)
    assert found.columns == ["case_id", "v"] and [r["v"] for r in found.collect()] == sorted(ids)[start : None if limit is None else start + limit]
    lineage.release()


def test_a_slice_reads_only_what_it_touches(spark) -> None:
    rows = spark.range(4000).selectExpr("printf('%05d', id) AS case_id", "id AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        part = positions.sliced(rows, ["case_id"], 1990, 20)
        assert sorted(r["v"] for r in part.collect()) == list(range(1990, 2010))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # The slice lies in one or two of four ranges, and the scan reads the files of these alone.
    told = plan(part)
    filters = re.search(r"PartitionFilters: \[([^]]*)\]", told)[1]
    assert "SinglePartition" not in told and "_part" in filters and len(set(re.findall(r"\d+", re.sub(r"#\d+", "", filters)))) <= 2
    assert positions.sliced(rows.limit(0), ["case_id"], 0, 5).count() == 0
    lineage.release()


def test_json_lines_reject(spark, tmp_path) -> None:
    good = '{"case_id": "A", "fee_status": "paid", "confidence": 0.5, "more": {"x": 1}}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join([good, '{"case_id": "B", "fee_st', "", "[1, 2]", '{"case_id": "C", "confidence": "much"}', "7", '{"case_id": "D"}', "null", "{}"]))
    (tmp_path / "in/b.jsonl").write_text("x\n" + good.replace('"A"', '"E"'))
    out = checked.json_lines(spark, str(tmp_path / "in"))
    assert sorted((r["case_id"] or "", r["fee_status"], r["confidence"]) for r in out.rows.collect()) == [("", None, None), ("A", "paid", 0.5), ("D", None, None), ("E", "paid", 0.5)]
    assert set(out.rows.columns) == set(V.RECORD_FIELDS)
    told = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in out.rejects.collect())
    assert told == [("a.jsonl", 2, "no JSON object"), ("a.jsonl", 4, "no JSON object"), ("a.jsonl", 5, "confidence is no double"), ("a.jsonl", 6, "no JSON object"), ("a.jsonl", 8, "no JSON object"), ("b.jsonl", 1, "no JSON object")]
    assert {r["text"] for r in out.rejects.collect()} >= {"[1, 2]", '{"case_id": "B", "fee_st'}


def test_csv_rejects(spark, tmp_path) -> None:
    schema = readers.schema_of("case_id string, adjudication string, n int")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('adjudication,case_id,n\nAPPROVED,C1,5\nDENIED,C2\n"A, b",C3,\nX,C4,many\nX,C5,1,2\n')
    (tmp_path / "in/b.csv").write_text("case_id,n\nC6,7\n")
    out = checked.csv_rows(spark, str(tmp_path / "in"), schema)
    assert sorted(map(tuple, out.rows.collect())) == [("C1", "APPROVED", 5), ("C3", "A, b", None), ("C6", None, 7)]
    told = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in out.rejects.collect())
    assert told == [("a.csv", 3, "not 3 fields"), ("a.csv", 5, "n is no int"), ("a.csv", 6, "not 3 fields"), ("b.csv", 1, "no column adjudication")]


def test_line_numbers_over_splits(spark, tmp_path) -> None:
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = checked.lines(spark, str(tmp_path / "a.txt"))
        assert all(r["line"] == int(r["text"]) for r in rows.collect()) and rows.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("digits", [1, 3])
def test_reservoirs(spark, monkeypatch, digits) -> None:
    """Equal to sorting each class by its digest, however the items are dealt and the cells cut."""
    monkeypatch.setattr(analysis, "DIGITS", digits)
    r = random.Random(5)
    items = [(f"C{r.randrange(400)}", i, r.choice(["a", "a", "a", "b", None])) for i in range(2000)]
    frame = spark.createDataFrame(items, "case_id string, n int, label string")
    wanted: set = set()
    for label, quota in (("a", 333), ("b", 0), (None, 10**6)):
        own = sorted((x for x in items if x[2] == label), key=lambda x: (hashlib.md5(x[0].encode()).hexdigest(), x[1]))
        wanted |= set(own[:quota])
    seen = {}

    def quota(counts: dict) -> dict:
        seen.update(counts)
        return {"a": 333, "b": 0}

    for n in (1, 6):
        out = analysis.reservoir(frame.repartition(n), "label", "case_id", ["n"], quota)
        assert out.columns == frame.columns and {tuple(x) for x in out.collect()} == wanted
    assert seen == dict(Counter(x[2] for x in items)) and "SinglePartition" not in plan(out)
    assert analysis.reservoir(frame.limit(0), "label", "case_id", ["n"], quota).count() == 0
    lineage.release()
