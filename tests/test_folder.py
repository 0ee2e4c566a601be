"""A folder of packets through the wired source, adapters, engine and sinks, with stand-ins for libraries and programs."""

from __future__ import annotations

import json
import os
import tempfile
from collections import Counter
from pathlib import Path

import pytest
from conftest import STANDINS
from pyspark.sql import functions as F

from packetlens.functions import vocab as V
from packetlens.operators import driver
from packetlens import lineage
from packetlens.plans import folder
from packetlens.sources import commits, packets, rasters, readers, sinks

FORM = ["Visa Class: XW-1", "Sponsor ID: SPN-1234", "Finding: DENIED"]


@pytest.fixture
def standins(monkeypatch):
    monkeypatch.syspath_prepend(str(STANDINS))


class Made:
    """A folder of packets, and what was done with them."""

    def __init__(self, path: Path):
        self.path, self.log = path / "in", path / "log"
        self.path.mkdir()
        self.log.write_text("")

    def add(self, name: str, **content) -> None:
        (self.path / f"{name}.pdf").write_text(json.dumps({"name": name, "log": str(self.log), **content}))

    def done(self, what: str) -> Counter:
        """How often each packet underwent what."""
        return Counter(line.split()[0] for line in self.log.read_text().splitlines() if line.split()[2] == what)


@pytest.fixture
def made(tmp_path):
    return Made(tmp_path)


def test_a_long_packet_is_many_tasks_and_opened_once_for_all_relations(spark, made, standins) -> None:
    made.add("long", n=1000, text="some text", pad="x" * 9000)
    made.add("short", pages=[{"text": FORM, "images": [[800, 900, ["x"]]]}, {"text": ["b"], "broken": True}, {}])
    (made.path / "junk.pdf").write_text("no packet")
    (made.path / "else.txt").write_text("no packet either")
    size = (made.path / "long.pdf").stat().st_size
    told = folder.Progress()
    parts = folder.opened(spark, str(made.path), told, splitBytes=str(size // 8 + 1))
    assert told.settled() == {"packets": 3, "pages": 1002, "unreadable_packets": 1, "unreadable_pages": 1}
    assert parts.pages.count() == 1002 and parts.spans.count() == 1003 and parts.images.count() == 1
    assert made.done("open") == {"long": 8, "short": 1}  # once a page range: its pages, text and images come in one pass
    assert {(r["case_id"], r["n_pages"]) for r in parts.packets.collect()} == {("long", 1000), ("short", 3)}
    errors = {(r["case_id"], r["page"]): r["error"] for r in parts.errors.collect()}
    assert set(errors) == {("junk", None), ("short", 2)} and errors["short", 2] == "ValueError: broken page"
    assert {r["case_id"] for r in parts.cases.collect()} == {"long", "short", "junk"}
    numbers = [r["page"] for r in parts.pages.where("case_id = 'long'").orderBy("page").collect()]
    assert numbers == list(range(1, 1001))
    lineage.release()


def test_splits() -> None:
    assert packets.splits([], 10) == []
    files = [("a", 4), ("b", 5), ("c", 0), ("d", 25), ("e", 10), ("f", 1)]
    assert packets.splits(files, 10) == [[("d", 0, 3)], [("d", 1, 3)], [("d", 2, 3)], [("a", 0, 1), ("b", 0, 1), ("c", 0, 1)], [("e", 0, 1)], [("f", 0, 1)]]
    pieces = sorted(p for split in packets.splits(files, 10) for p in split)
    assert pieces == [("a", 0, 1), ("b", 0, 1), ("c", 0, 1), ("d", 0, 3), ("d", 1, 3), ("d", 2, 3), ("e", 0, 1), ("f", 0, 1)]


def test_what_is_not_asked_for_is_not_made(spark, made, standins) -> None:
    made.add("A", pages=[{"text": FORM, "images": [[800, 900, ["x"]], [10, 20, ["y"]]]}])
    lean = packets.parts(spark, str(made.path), ["kind", "case_id", "page", "ord", "width", "height"])
    rows = lean.where("kind = 'image'").orderBy("ord").collect()
    assert [(r["width"], r["height"]) for r in rows] == [(800.0, 900.0), (10.0, 20.0)] and made.done("decode") == {}
    assert packets.parts(spark, str(made.path)).where(F.col("kind").isin("page", "span")).count() == 4 and made.done("decode") == {}
    whole = packets.relation(packets.parts(spark, str(made.path)), packets.IMAGE).collect()
    assert [(r["width"], r["channels"], bytes(r["content"])) for r in sorted(whole, key=lambda r: r["img_no"])] == [(800, 3, b'["x"]'), (10, 3, b'["y"]')] and made.done("decode") == {"A": 2}
    empty = made.path / "none"
    empty.mkdir()
    assert packets.parts(spark, str(empty)).count() == 0


def test_folder_to_lines_with_ocr(spark, made, standins, tmp_path) -> None:
    """A packet of ink alone is decided by OCR, one of text by its text; the second run draws nothing, a changed packet its own pages only."""
    made.add("ink", pages=[{"ink": ["Adjudication Record", *FORM]}, {"text": ["Packet 1"], "ink": ["Home World: Kepler"]}])
    made.add("text", pages=[{"text": [*FORM, "Home World: Kepler"]}])
    made.add("bad", pages=[{"undrawable": True}])
    (made.path / "junk.pdf").write_text("no packet")
    heard, out, cache = [], str(tmp_path / "out"), str(tmp_path / "cache")
    counts = folder.run(spark, str(made.path), out, with_neural=False, files=1, cache=cache, listener=heard.append)
    found = {x["case_id"]: x for x in map(json.loads, next((tmp_path / "out").glob("part-*")).read_text().splitlines())}
    assert set(found) == {"ink", "text", "bad", "junk"} and found["junk"] == {"case_id": "junk", **V.BLANK}
    assert found["ink"]["visa_class"] == found["text"]["visa_class"] == "XW-1" and found["text"]["adjudication"] == "DENIED"
    drawn = made.done("draw")
    assert drawn == {"ink": 2, "bad": 1}
    assert {k: counts[k] for k in ("packets", "pages", "unreadable_packets", "records", "blank_records")} == {"packets": 4, "pages": 4, "unreadable_packets": 1, "records": 4, "blank_records": 1}
    assert counts["ocr_reads"] >= 2 and counts["denied"] + counts["needs_review"] + counts["approved"] == 4
    assert [set(h) - {"packets"} for h in heard][0] >= {"pages"} and heard[-1] == counts
    again = folder.run(spark, str(made.path), out, with_neural=False, cache=cache)
    assert again == counts and made.done("draw") == drawn
    made.add("ink", pages=[{"ink": ["Visa Class: MED-3"]}])
    folder.run(spark, str(made.path), out, with_neural=False, cache=cache)
    assert made.done("draw") == {"ink": 3, "bad": 1}


def test_neural_passes_share_their_drawings(spark, made, standins, tmp_path) -> None:
    made.add("A", pages=[{"text": ["nothing"], "ink": ["Fee Status: paid", "Visa Class: XW-1"], "images": [[900, 900, ["x"]]]}])
    out = str(tmp_path / "out")
    for _ in range(2):
        folder.run(spark, str(made.path), out, with_ocr=False, cache=str(tmp_path / "cache"))
    record = readers.records(spark, out).first()
    assert record["visa_class"] in {"XW-1", "XW-2"} and record["fee_status"] == "paid"
    lines = [x.split()[2:] for x in made.log.read_text().splitlines() if " draw " in x]
    assert lines and len(lines) == len({tuple(x) for x in lines})  # each page and resolution once in both runs


def test_command_line(spark, made, standins, tmp_path, capsys) -> None:
    """A readable and an unreadable packet: every packet gets a line, and the counts are printed."""
    made.add("A", pages=[{"text": FORM}])
    (made.path / "B.pdf").write_text("junk")
    counts = folder.main([str(made.path), str(tmp_path / "out"), "--files", "1", "--no-ocr", "--no-neural"])
    lines = [json.loads(x) for x in next((tmp_path / "out").glob("part-*")).read_text().splitlines()]
    assert [x["case_id"] for x in lines] == ["A", "B"] and lines[0]["sponsor_id"] == "SPN-1234" and lines[0]["adjudication"] == "DENIED"
    assert lines[1] == {"case_id": "B", **V.BLANK} and json.loads(capsys.readouterr().out) == counts


def test_a_repeated_run_is_there_once(spark, made, standins, tmp_path) -> None:
    made.add("A", pages=[{"text": FORM}])
    out = str(tmp_path / "out")
    for run in ("monday", "monday", "tuesday"):
        folder.run(spark, str(made.path), out, with_ocr=False, with_neural=False, run_id=run)
    assert sinks.committed_records(spark, out).count() == 2
    assert [r.name for r in commits.Folder(spark, out).runs()] == ["monday", "tuesday"]


def test_a_failed_write_leaves_nothing_that_counts(spark, tmp_path) -> None:
    """A task fails after others have written; the run is repeated, and every case is there once."""
    records = driver.blank_records(spark.range(40).select(F.format_string("C%02d", "id").alias("case_id")))
    out = str(tmp_path / "out")
    assert sinks.committed_records(spark, out).count() == 0
    broken = records.withColumn("applicant_name", F.when(F.col("case_id") == "C39", F.raise_error(F.lit("lost"))).otherwise(F.col("applicant_name")))
    with pytest.raises(Exception, match="lost"):
        sinks.commit_records(broken, out, "first")
    assert sinks.committed_records(spark, out).count() == 0 and not list((tmp_path / "out").glob("data/*"))
    assert sinks.commit_records(records, out, "first") and not sinks.commit_records(records, out, "first")
    assert sorted(r["case_id"] for r in sinks.committed_records(spark, out).collect()) == [f"C{i:02d}" for i in range(40)]
    with pytest.raises(ValueError, match="name"):
        sinks.commit_records(records, out, "../else")


def test_a_replacing_run_hides_those_before(spark, tmp_path) -> None:
    one = driver.blank_records(spark.createDataFrame([("A",)], "case_id string"))
    out = commits.Folder(spark, str(tmp_path / "out"))
    for run, replace in (("a", False), ("b", False), ("c", True), ("d", False)):
        sinks.commit_records(one, out.path, run, replace=replace)
    assert [r.name for r in out.runs()] == ["c", "d"]
    (tmp_path / "out/_runs/dead").write_text('{"name": ')  # a writer died here
    assert [r.name for r in out.runs()] == ["c", "d"]
    assert sinks.commit_records(one, out.path, "dead") and [r.name for r in out.runs()] == ["c", "d", "dead"]
    (tmp_path / "out/data/left").mkdir()
    assert out.tidy() == 3 and sinks.committed_records(spark, out.path).count() == 3
    assert {p.name.split(".")[0] for p in (tmp_path / "out/data").iterdir()} == {"c", "d", "dead"}


def test_pages_drawn_twice_count_once(spark, made, standins, tmp_path) -> None:
    """Two runs at a time may draw the same page; packets of one content share theirs."""
    made.add("A", pages=[{"ink": ["a"]}])
    body = (made.path / "A.pdf").read_text()
    (made.path / "B.pdf").write_text(body)
    cache = str(tmp_path / "cache")
    parts = folder.opened(spark, str(made.path), folder.Progress())
    wanted = spark.createDataFrame([("A", 1), ("B", 1), ("B", 1), ("B", 7), ("A", None)], "case_id string, page int")
    drawn = lambda: sorted((r["case_id"], r["page"], r["dpi"], bytes(r["content"])) for r in rasters.drawn_pages(parts.packets, wanted, 180, cache).collect())
    first = drawn()
    assert first == [("A", 1, 180, b'["a"]'), ("B", 1, 180, b'["a"]')] and made.done("draw") == {"A": 1}
    store = commits.Folder(spark, f"{cache}/dpi=180")
    store.commit("twin", spark.read.parquet(store.runs()[0].path).write.parquet)
    assert drawn() == first and made.done("draw") == {"A": 1}
    lineage.release()


def test_a_failing_task_leaves_no_temporary_files(spark, made, standins, monkeypatch) -> None:
    """Images are handed to programs in files of their own, which go when the read fails or raises."""
    before = set(os.listdir(tempfile.gettempdir()))
    images = spark.createDataFrame([("A", 1, 160, bytearray(b"not json")), ("A", 2, 160, bytearray(b'["ok"]'))], readers.RASTERS)
    from packetlens.sources import adapters

    assert [r["text"] for r in adapters.ocr_words(images).collect()] == ["ok"]
    with pytest.raises(Exception, match="lost"):
        adapters.ocr_words(images).withColumn("text", F.raise_error(F.lit("lost"))).collect()
    left = {x for x in set(os.listdir(tempfile.gettempdir())) - before if x.endswith(".png")}
    assert not left
