"""Operators of the packet engine on small relations."""

from __future__ import annotations

import importlib.util
import json
import os
import random
import re
import sys
import types
from ast import literal_eval

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetlens.functions import patterns as P
from packetlens.functions import vocab as V
from packetlens.operators import analysis, decide, driver, fill, ocr, repair, resolve, spans
from packetlens.operators import candidates as C
from packetlens.plans import catalog, fixtures, folder, pipeline
from packetlens.sources import adapters, readers, sinks
from packetlens.streaming.incremental import adjudicate_stream

SPAN = "case_id string, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, size double, color int, source string"


def cells(rows, case="A", page=1, source="text_layer", start=0):
    """Spans from (label, value) rows, 10 units apart, or single texts."""
    out = []
    for i, row in enumerate(rows):
        y = 10.0 * i
        parts = [(row, 0.0, 1.0)] if isinstance(row, str) else [(row[0], 0.0, 1.0), (row[1], 20.0, 30.0)]
        out += [(case, page, start + 2 * i + j, t, x0, y, x1, y + 5, 9.0, 0, source) for j, (t, x0, x1) in enumerate(parts)]
    return out


def picked(spark, rows):
    found = resolve.pick_fields(C.candidates(spark.createDataFrame(rows, SPAN)))
    return {r["field"]: (r["value"], r["source"], r["conflict"]) for r in found.collect()}


def test_amount_and_waiver_override_a_struck_status(spark) -> None:
    rows = cells(["Fee Receipt", ("Fee Status", "unknown"), ("Amount", "$0.00"), ("Waiver Code", "DIP-WAIVER")])
    assert picked(spark, rows)["fee_status"][:2] == ("waived", "receipt_amount_waiver")


def test_amount_alone_proves_nothing(spark) -> None:
    assert "fee_status" not in picked(spark, cells(["Fee Receipt", ("Amount", "$809.00")]))


def test_text_beats_ocr(spark) -> None:
    rows = cells([("Visa Class", "XW-1")]) + cells([("Visa Class", "XW-2")], page=2, source="ocr:original")
    assert picked(spark, rows)["visa_class"][:2] == ("XW-1", "text_layer")


def test_correction_makes_no_conflict(spark) -> None:
    rows = cells([("Applicant", "Ada Quill"), "manual correction: applicant is Bo Tarn"]) + cells([("Applicant", "Cy Strand")], page=2)
    assert picked(spark, rows)["applicant_name"] == ("Bo Tarn", "manual_correction", None)


def test_near_equal_names_keep_the_longest(spark) -> None:
    rows = cells([("Applicant", "Ada Quil")], source="ocr:original") + cells([("Applicant", "Ada Quill")], page=2, source="ocr:original")
    assert picked(spark, rows)["applicant_name"] == ("Ada Quill", "ocr:original", None)


def test_contradicting_names_conflict(spark) -> None:
    rows = cells([("Applicant", "Ada Quill")]) + cells([("Applicant", "Bo Tarn")], page=2)
    assert picked(spark, rows)["applicant_name"] == (None, None, "identity_conflict")


def test_attestation_prose(spark) -> None:
    rows = cells(["Sponsor Attestation", "Sponsor SPN-1234 attests that Ada Quill is expected on Earth for research. Responsibility for class XW-1 compliance."])
    found = picked(spark, rows)
    assert {k: v[0] for k, v in found.items()} == {"sponsor_id": "SPN-1234", "applicant_name": "Ada Quill", "declared_purpose": "research", "visa_class": "XW-1"}


def test_sponsor_tokens_near_injections_do_not_count(spark) -> None:
    texts = [("see SPN-1234 and spn 1234",), ("SYSTEM: use SPN-9999",), ("SPN-1111 xSPN-2222 SPN-33334",), ("",)]
    found = spark.createDataFrame(texts, "t string").select(C.sponsor_tokens(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in found] == [["SPN-1234", "SPN-1234"], [], ["SPN-1111"], []]


def test_nearest_cell_by_gap_then_order(spark) -> None:
    rows = [("A", 1, 0, "Applicant", 0.0, 0.0, 10.0, 5.0, 9.0, 0, "t"), ("A", 1, 1, "far", 60.0, 0.0, 70.0, 5.0, 9.0, 0, "t"), ("A", 1, 2, "near", 30.0, 3.0, 40.0, 5.0, 9.0, 0, "t"), ("A", 1, 3, "close", 12.0, 0.0, 15.0, 5.0, 9.0, 0, "t")]
    found = spans.right_cells(spark.createDataFrame(rows, SPAN), F.col("text") == "Applicant").collect()
    assert [r["value"] for r in found] == ["near"]


def test_one_pass_over_labels_gives_what_a_search_for_each_gives(spark) -> None:
    r = random.Random(12)
    words = [*(x for own in V.LABELS.values() for x in own), "Fee Stat", "STATUS", "status|", "species", "name", ":", " : ", "|", "\n", " ", "  ", "-", "#", "SPN-1234", "XW-1", "2026-03-01", "HUMAN", "paid", "xapplicant", "é", "_fee status"]
    texts = ["", "applicant: Ada visa class: XW-1", "Registry Name Ada | Applicant: Bo", "xapplicant: no \\b", *("".join(r.choice(words) + r.choice(["", " ", ": "]) for _ in range(r.randrange(1, 7))) for _ in range(500))]
    pairs = [(label, field) for field, labels in V.LABELS.items() for label in labels]
    heads = F.col("heads")
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("heads", C.label_heads(F.col("t")))
    got = frame.select("t", F.array(*(v for _, _, v in C.label_values(heads))).alias("pairs"), F.array(*(C.glued_value(heads, f) for f in V.LABELS)).alias("glued"), F.array(*(analysis.label_value(F.col("t"), x) for x in analysis.FLAT_LABELS.values())).alias("flat")).collect()
    collapse = lambda m, k=1: None if m is None or not m[k] else re.sub(r"\s+", " ", m[k]).strip(" ")
    tails = {"sponsor_id": P.GLUED_SPONSOR, "visa_class": P.GLUED_VISA, "arrival_date": P.GLUED_DAY, "species_code": P.GLUED_SPECIES}
    seen = 0
    for row in got:
        t = row["t"]
        assert row["pairs"] == [collapse(re.search(rf"\b{label}\s*:\s*([^|]+)$", t, re.I)) for label, _ in pairs], t
        glued = [collapse(re.search(V.FEE_LABEL + P.GLUED_FEE if f == "fee_status" else rf"(?:{'|'.join(labels)})" + tails.get(f, P.GLUED_ANY), t, re.I)) for f, labels in V.LABELS.items()]
        assert row["glued"] == glued, t
        flat = [next((v for x in labels if (v := collapse(re.search(rf"{x}\s*[:#-]\s*(.+?)(?:\s+(?:{analysis.NEXT_LABEL})\s*[:#-]|$)", t, re.I))) is not None), None) for labels in analysis.FLAT_LABELS.values()]
        assert row["flat"] == flat, t
        seen += sum(x is not None for x in row["pairs"] + row["glued"] + row["flat"])
    assert seen > 500


RECORD = {"applicant_name": "Ada Quill", "species_code": "HUMAN", "home_world": "Kepler", "visa_class": "XW-2", "sponsor_id": "SPN-1234", "arrival_date": "2026-03-01", "declared_purpose": "research", "risk_flags": "none", "fee_status": "paid"}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, "no_override"),
        ({"risk_flags": "active_warrant"}, "disqualifying_risk"),
        ({"sponsor_id": "SPN-0007"}, "revoked_sponsor"),
        ({"sponsor_id": "SPN-0007", "visa_class": "DIP-1"}, "no_override"),
        ({"visa_class": "TRANSIT-7"}, "transit_not_work_authorized"),
        ({"fee_status": "unpaid"}, "unpaid_fee"),
        ({"arrival_date": "2025-12-31"}, "stale_arrival"),
        ({"arrival_date": "1900-01-01"}, "no_override"),
        ({"sponsor_id": "SPN-0000"}, "missing_sponsor"),
        ({"fee_status": "unknown"}, "missing_policy_evidence"),
        ({"fee_status": "waived"}, "unverified_fee_waiver"),
        ({"risk_flags": "rescinded_denial"}, "review_only_risk"),
    ],
)
def test_policy(spark, change, reason) -> None:
    row = RECORD | change
    assert spark.createDataFrame([row]).select(decide.policy_reason().alias("r")).first()["r"] == reason


def packet(spark, **change):
    base = RECORD | {f"{f}_state": "resolved" for f in V.SCALARS} | {f"{f}_source": "text_layer" for f in V.SCALARS}
    base |= {"case_id": "A", "flags": [], "risk_state": "resolved", "risk_value": "none", "risk_source": "text_layer", "manual": None, "manual_source": None, "page_text": "", "all_text": "", "layout_text": ""}
    base |= change
    kinds = {k: "array<string>" if k == "flags" else "string" for k in base}
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))


@pytest.mark.parametrize(
    ("change", "decision", "reason"),
    [
        ({}, "APPROVED", "no_override"),
        ({"risk_state": "unknown", "risk_value": None, "risk_source": None}, "NEEDS_REVIEW", "unresolved_risk"),
        ({"risk_state": "unknown", "risk_value": None, "manual": "APPROVED", "manual_source": "ocr"}, "NEEDS_REVIEW", "finding_without_risk"),
        ({"risk_state": "unknown", "risk_value": None, "manual": "APPROVED", "manual_source": "text_layer"}, "APPROVED", "manual_finding"),
        ({"manual": "DENIED", "manual_source": "ocr"}, "DENIED", "manual_finding"),
        ({"home_world": "Eris Relay"}, "DENIED", "hard_denial"),
        ({"home_world": "Wolf-1061c", "visa_class": "DIP-1"}, "APPROVED", "no_override"),
        ({"sponsor_id": "SPN-2718"}, "DENIED", "hard_denial"),
        ({"sponsor_id_source": "sponsor_attestation", "home_world_source": "ocr", "risk_source": "ocr"}, "NEEDS_REVIEW", "attestation_only"),
        ({"sponsor_id_source": "sponsor_attestation", "home_world_source": "ocr"}, "APPROVED", "no_override"),
    ],
)
def test_decide(spark, change, decision, reason) -> None:
    row = decide.decide(packet(spark, **change)).first()
    assert (row["adjudication"], row["reason"]) == (decision, reason)


def test_gates(spark) -> None:
    review = {"adjudication": "NEEDS_REVIEW", "confidence": "0.41", "gate": None}
    clean = packet(spark, **review, page_text="Observed flags: none", layout_text="Amount $809.00").withColumn("confidence", F.lit(0.41))
    row = decide.clean_gate(clean).first()
    assert (row["adjudication"], row["gate"], row["risk_source"], row["confidence"]) == ("APPROVED", "clean_packet", "layout_clearance", 0.68)
    by_ocr = packet(spark, **review, all_text="Observed flags: none", layout_text="Amount $809.00").withColumn("confidence", F.lit(0.41))
    assert decide.clean_gate(by_ocr).first()["adjudication"] == "NEEDS_REVIEW"
    proof = "Registry Name Ada Quill\nApplicant: Ada Quill\nAmount $809.00"
    both = packet(spark, **review, risk_state="unknown", risk_value=None, layout_text=proof).withColumn("confidence", F.lit(0.41))
    assert decide.consensus_gate(both).first()["gate"] == "layout_consensus"
    risky = packet(spark, **review, layout_text=f"{proof}\nbiohazard red").withColumn("confidence", F.lit(0.41))
    assert decide.consensus_gate(risky).first()["gate"] is None


def test_fill_never_overrides_the_text_layer(spark) -> None:
    texts = spark.createDataFrame([("A", "rapid", "Fee Status: paid\nVisa Class: XW1\nObserved flags: none")], "case_id string, stage string, text string")
    read = fill.stored_reader(texts, "rapid")
    open_ = {"fee_status": "unknown", "fee_status_state": "unknown", "risk_state": "unknown", "risk_value": None, "risk_source": None}
    row = fill.fill_unknown(packet(spark, **open_), read).first()
    assert (row["fee_status"], row["risk_value"], row["risk_source"], row["visa_class"]) == ("unknown", "none", "rapidocr", "XW-2")
    row = fill.fill_unknown(packet(spark, **open_, fee_status_source="ocr"), read).first()
    assert (row["fee_status"], row["fee_status_source"]) == ("paid", "rapidocr")
    boosted = fill.boost_fee(packet(spark, **open_), read).first()
    assert boosted["fee_status"] == "paid"


def test_no_reader_runs_for_resolved_packets(spark) -> None:
    seen = []

    def read(cases):
        seen.append(cases.count())
        return cases.select("case_id", F.lit("x").alias("text"))

    fill.fill_unknown(packet(spark), read)
    fill.forensic_risk(packet(spark), read)
    assert seen == [0, 0]


def test_repairs(spark) -> None:
    weak = packet(spark, visa_class="UNKNOWN", visa_class_state="unknown", fee_status="unpaid", layout_text="Amount $809\nresponsibility for class MED-3 compliance\nRevoked sponsor: SPN-4040", sponsor_id_source="ocr")
    row = repair.repair(weak).first()
    assert (row["visa_class"], row["fee_status"], row["sponsor_id"], row["sponsor_id_source"]) == ("MED-3", "paid", "SPN-4040", "layout_text")
    assert repair.repair(packet(spark)).first()["visa_class"] == "XW-2"


def test_ocr_words_and_guards(spark) -> None:
    words = spark.createDataFrame(
        [("A", "ocr:original", "1", "1", "1", "1", "30", "5", "10", "8", "90", "world"), ("A", "ocr:original", "1", "1", "1", "1", "10", "6", "10", "8", "70", " hello "), ("A", "ocr:original", "1", "1", "1", "1", "1", "1", "1", "1", "-1", "no"), ("A", "ocr:original", "1", "1", "1", "2", "x", "1", "1", "1", "50", "bad")],
        readers.WORDS,
    )
    row = ocr.words_to_lines(words).collect()
    assert [(r["text"], r["confidence"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in row] == [("hello world", 0.8, 10, 5, 40, 14)]
    line = "case_id string, page int, source string, text string, confidence double, x0 int, y0 int, x1 int, y1 int"
    original = spark.createDataFrame([("A", 1, "ocr:original", "Fee Receipt", 0.9, 0, 0, 1, 1), ("B", 1, "ocr:original", "active warrant", 0.9, 0, 0, 1, 1)], line)
    retry = spark.createDataFrame([("A", 1, "ocr:contrast_risk", "biohazard", 0.5, 0, 0, 1, 1), ("B", 1, "ocr:contrast_risk", "embargo", 0.5, 0, 0, 1, 1), ("A", 1, "ocr:contrast_risk", "warrant", 0.3, 0, 0, 1, 1)], line)
    assert [r["text"] for r in ocr.contrast_lines(original, retry).collect()] == ["biohazard"]
    assert [r["case_id"] for r in ocr.fee_crop_pages(original).collect()] == ["A"]
    layer = spark.createDataFrame(cells(["x"]), SPAN)
    merged = ocr.evidence_spans(layer, original, retry, spark.createDataFrame([("A", 1, "ocr:fee_crop", "paid", 0.9, 0, 0, 1, 1)], line), original.limit(0))
    assert sorted(r["text"] for r in merged.collect()) == ["Fee Receipt", "active warrant", "biohazard", "paid", "x"]


def test_analysis(spark) -> None:
    pages = spark.createDataFrame([("A", 1, "contrast", "Applicant: Zed Fee: paid", 0.99), ("A", 2, "original", "Applicant - Ada Quill Visa Class: xw-1 SPN-1234", 0.5)], readers.OCR_PAGES)
    row = analysis.extract_flat(pages).first()
    assert (row["applicant_name"], row["visa_class"], row["sponsor_id"], row["fee_status"], row["risk_flags"]) == ("Ada Quill", "XW-1", "SPN-1234", "paid", "none")


def test_driver_operators(spark, tmp_path) -> None:
    packets = spark.createDataFrame([(f"C{i}", i) for i in range(10)], "case_id string, v int")
    assert [r["v"] for r in driver.take_slice(packets, 2, 3).collect()] == [2, 3, 4]
    (tmp_path / "list.txt").write_text("C3\n\n C1 \n")
    listed = readers.case_list(spark, str(tmp_path / "list.txt"))
    assert [r["v"] for r in driver.by_case_list(packets, listed).orderBy("pos").collect()] == [3, 1]
    missing = spark.createDataFrame([("nope", 0)], "case_id string, pos long")
    with pytest.raises(Exception, match="no packet for case nope"):
        driver.by_case_list(packets, missing).collect()
    records = driver.blank_records(packets.select("case_id"))
    sinks.write_records(records, str(tmp_path / "out"), files=1)
    lines = [json.loads(x) for x in sorted((tmp_path / "out").glob("part-*"))[0].read_text().splitlines()]
    assert [x["case_id"] for x in lines] == [f"C{i}" for i in range(10)] and list(lines[0]) == sorted(V.RECORD_FIELDS)
    sinks.append_records(records, str(tmp_path / "out"))
    assert readers.records(spark, str(tmp_path / "out")).count() == 20
    (tmp_path / "truth.csv").write_text("adjudication,case_id\nAPPROVED,C1\n")
    assert readers.truth(spark, str(tmp_path / "truth.csv")).first()["case_id"] == "C1"
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert readers.packets(spark, str(tmp_path)).first()["case_id"] == "a"


def test_rows_of_pages_and_words() -> None:
    """What parsers return, as stored dictionaries and tables."""
    page = {"blocks": [{"type": 1}, {"lines": [{"spans": [{"text": "Visa", "bbox": (1, 2, 3, 4), "size": 9, "color": 255}, {"text": "XW-1", "bbox": (5, 2, 8, 4), "size": 9.5, "color": 0}]}, {}]}, {"lines": [{"spans": [{"text": "", "bbox": (0, 0, 0, 0), "size": 1, "color": 0}]}]}]}
    found = list(adapters.span_rows("A", 3, page))
    assert found == [("A", 3, 0, "Visa", 1.0, 2.0, 3.0, 4.0, 9.0, 255, "text_layer"), ("A", 3, 1, "XW-1", 5.0, 2.0, 8.0, 4.0, 9.5, 0, "text_layer"), ("A", 3, 2, "", 0.0, 0.0, 0.0, 0.0, 1.0, 0, "text_layer")]
    assert list(adapters.span_rows("A", 1, {})) == []
    table = "level\tpage_num\tblock_num\tleft\tconf\ttext\n5\t1\t2\t10\t96.5\tFee\n5\t1\t2\t30\n"
    rows = [dict(zip(readers.WORDS.names, r, strict=True)) for r in adapters.word_rows("A", 7, "ocr:original", table)]
    assert [(r["case_id"], r["page_num"], r["block_num"], r["left"], r["conf"], r["text"], r["top"]) for r in rows] == [("A", "7", "2", "10", "96.5", "Fee", ""), ("A", "7", "2", "30", "", "", "")]
    assert list(adapters.word_rows("A", 7, "ocr:original", "")) == []


def test_texts_of_a_failed_read_are_empty(monkeypatch, tmp_path) -> None:
    program = tmp_path / "tesseract"
    program.write_text('#!/bin/sh\n[ "$4" = 11 ] && exit 1\necho "read in mode $4 of $(cat "$1")"\n')
    program.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert adapters._read(b"page", 6) == "read in mode 6 of page\n" and adapters._read(b"page", 11) == ""


def test_means_do_not_depend_on_partitions(spark, sf) -> None:
    """Every query with an average, on its rows dealt in three ways."""
    r = random.Random(4)
    words = [("A", "o", str(p), "1", "1", str(n), str(r.randrange(400)), "1", "5", "5", f"{r.randrange(10000) / 100:.2f}", "w") for p in range(30) for n in range(12) for _ in range(r.randrange(1, 8))]
    frame = spark.createDataFrame(words, readers.WORDS)
    truth = spark.createDataFrame([(f"C{i}", "APPROVED") for i in range(3000)], "case_id string, adjudication string")
    said = spark.createDataFrame([(f"C{i}", r.choice(["APPROVED", "DENIED"]), r.randrange(1000) / 1000 + 1e-17) for i in range(3000)], "case_id string, adjudication string, confidence double")
    found = set()
    for n in (1, 3, 7):
        dealt = frame.repartition(n, F.rand(n))
        lines = ocr.words_to_lines(dealt)
        means = ocr.mean_confidence(lines.repartition(n, F.rand(n)), ["case_id", "page_num"])
        bins = analysis.calibration(truth, said.repartition(n, F.rand(n)))
        found.add(repr([sorted(map(tuple, x.collect())) for x in (lines.select("page_num", "line_num", "confidence"), means, bins)]))
    assert len(found) == 1
    some = {repr(sorted(map(tuple, catalog.QUERIES["page_mean_confidence"](spark, sf).repartition(n).collect()))) for n in (1, 5)}
    assert len(some) == 1


def test_gates_share_the_proofs_of_the_repairs(spark, sf) -> None:
    wide = catalog.wide(spark, sf).limit(50)
    repaired = repair.repair(wide)
    assert {"proof", "page_proof"} <= set(repaired.columns)
    alone = decide.gates(decide.decide(repaired.drop("proof", "page_proof")))
    assert sorted(map(tuple, decide.emit(decide.gates(decide.decide(repaired))).collect())) == sorted(map(tuple, decide.emit(alone).collect()))


def test_adapters_say_what_is_missing(spark) -> None:
    with pytest.raises(adapters.AdapterMissing):
        adapters.text_spans(spark.createDataFrame([], "case_id string, content binary"))


def test_pages_are_drawn_and_read(spark, monkeypatch, tmp_path) -> None:
    """With a stand-in for pdftoppm that writes its arguments, and one for the neural reader."""
    program = tmp_path / "pdftoppm"
    program.write_text('#!/bin/sh\n[ "$5" -gt 2 ] && exit 0\nfor last; do :; done\necho "$3 $5 $7 $(cat "$8")" > "$last-$5.png"\n')
    program.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    assert adapters._rendered(b"body", 2, adapters.FORENSIC_DPI) == b"180 2 2 body\n" and adapters._rendered(b"body", 3, 180) is None
    monkeypatch.setattr(adapters, "_rendered", lambda content, page, dpi: None if page > 2 else content + b"%d@%d" % (page, dpi))
    monkeypatch.setattr(adapters, "_need", lambda *_: None)
    monkeypatch.setattr(adapters, "_crops", lambda content, forensic: [content.decode(), content.decode(), content.decode() + "!"] if forensic else [content.decode()])
    monkeypatch.setattr(adapters, "_engine", lambda: lambda image: type("Read", (), {"txts": (image, None, "end")}))

    def here(frame, run, schema):  # in this process, where the stand-ins are
        return spark.createDataFrame([tuple(r) for out in run([frame.toPandas()]) for r in out.itertuples(index=False)], schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", here)
    packets = spark.createDataFrame([("A", bytearray(b"a")), ("B", bytearray(b"b")), ("C", bytearray(b"c"))], "case_id string, content binary")
    pages = spark.createDataFrame([("A", 2), ("A", 1), ("A", 1), ("A", 3), ("B", 1), ("C", 1)], "case_id string, page int")
    drawn = adapters.render_pages(packets, pages, 140).orderBy("case_id", "page").collect()
    assert [(r["case_id"], r["page"], r["dpi"], bytes(r["content"])) for r in drawn] == [("A", 1, 140, b"a1@140"), ("A", 2, 140, b"a2@140"), ("B", 1, 140, b"b1@140"), ("C", 1, 140, b"c1@140")]
    cases = spark.createDataFrame([("A",), ("C",)], "case_id string")
    plain = {r["case_id"]: r["text"] for r in adapters.neural_reader(packets, pages)(cases).collect()}
    assert plain == {"A": "a1@140\nend\na2@140\nend", "C": "c1@140\nend"}
    deep = {r["case_id"]: r["text"] for r in adapters.neural_reader(packets, pages, adapters.FORENSIC_DPI, forensic=True)(cases).collect()}
    assert deep["C"] == "c1@180\nend\nc1@180!\nend"


class Picture:
    """A stand-in for a decoded image: its size and what was done to it."""

    def __init__(self, width: int, height: int, done: tuple = ()) -> None:
        self.width, self.height, self.done = width, height, done

    @property
    def size(self) -> tuple[int, int]:
        return self.width, self.height

    def then(self, *step, width: int | None = None, height: int | None = None) -> Picture:
        return Picture(width or self.width, height or self.height, (*self.done, step))

    def convert(self, mode):
        return self.then("convert", mode)

    def crop(self, box):
        return self.then("crop", box, width=box[2] - box[0], height=box[3] - box[1])

    def resize(self, size, how):
        return self.then("resize", size, how, width=size[0], height=size[1])

    def filter(self, what):
        return self.then("filter", what)

    def save(self, out, format):  # noqa: A002
        out.write(repr((format, self.size, self.done)).encode())


def pictures(monkeypatch) -> None:
    """Puts stand-ins for the imaging library into place; an image's bytes are its width and height."""
    names = {n: types.ModuleType(f"PIL.{n}") for n in ("Image", "ImageEnhance", "ImageFilter", "ImageOps")}
    names["Image"].open = lambda file: Picture(*map(int, file.read().split()))
    names["Image"].Resampling = {"BICUBIC": 3, "LANCZOS": 1}
    names["ImageOps"].grayscale, names["ImageOps"].autocontrast = lambda i: i.then("grey"), lambda i: i.then("level")
    names["ImageEnhance"].Contrast = lambda i: types.SimpleNamespace(enhance=lambda by: i.then("contrast", by))
    names["ImageFilter"].SHARPEN, names["ImageFilter"].MedianFilter = "sharpen", lambda size: ("median", size)
    whole = types.ModuleType("PIL")
    whole.__dict__.update(names)
    monkeypatch.setitem(sys.modules, "PIL", whole)
    for name, module in names.items():
        monkeypatch.setitem(sys.modules, f"PIL.{name}", module)


def test_views_of_an_image(monkeypatch) -> None:
    pictures(monkeypatch)
    made = lambda content, view: literal_eval(adapters._view_of(content, view).decode())
    seen = lambda view: made(b"1000 2000", view)[2][1:]
    assert made(b"1000 2000", adapters.View()) == ("PNG", (1000, 2000), (("convert", "RGB"),))
    assert seen(adapters.CONTRAST) == (("grey",), ("contrast", 1.8)) and seen(adapters.CLEAN) == (("grey",), ("contrast", 1.8), ("filter", ("median", 3)))
    assert seen(adapters.FEE) == (("crop", (20, 100, 920, 1160)), ("resize", (1800, 2120), 3))
    assert seen(adapters.FEE_LEVEL) == (*seen(adapters.FEE), ("grey",), ("level",))
    assert seen(adapters.HEADER) == (("crop", (0, 0, 920, 1160)), ("grey",), ("level",))
    assert seen(adapters.HEADER_LARGE) == (*seen(adapters.HEADER), ("resize", (1840, 2320), 1))
    assert seen(adapters.MID_LARGE) == (("crop", (0, 240, 920, 1160)), ("grey",), ("level",), ("resize", (1840, 1840), 1))
    assert made(b"1 1", adapters.HEADER)[1] == (1, 1)
    assert adapters._view_of(b"no picture", adapters.FEE) is None
    forensic = [adapters._seen(Picture(10, 100), view).done for view in adapters.FORENSIC]
    lower, middle = ("crop", (0, 50, 10, 100)), ("crop", (0, 25, 10, 75))
    assert forensic == [(), (("grey",), ("contrast", 2.0), ("filter", "sharpen")), (lower,), (lower, ("grey",), ("contrast", 2.2)), (middle,), (middle, ("grey",), ("contrast", 2.0))]


def test_ocr_ladder(spark, monkeypatch) -> None:
    """Each retry reads only the pages that need it; two images of a page keep their lines apart."""
    asked = []
    said = {
        b"p1": ["Fee Receipt"], b"p1+FEE": ["Fee Status: paid"], b"p1+FEE_LEVEL": "\n Status paid \n", b"p1+CONTRAST": ["embargo notice", "plain"],
        b"p2": ["active warrant"], b"i0+HEADER": ["left part"], b"i1+HEADER": ["right part"], b"i0+HEADER_LARGE": "sparse head", b"i1+HEADER_LARGE": " \n", b"i0+MID_LARGE": "sparse middle",
    }
    kinds = {getattr(adapters, n): n for n in ("CONTRAST", "FEE", "FEE_LEVEL", "HEADER", "HEADER_LARGE", "MID_LARGE")}

    def read(content: bytes, psm: int, *form: str) -> str:
        asked.append((content, psm))
        found = said.get(content, "" if psm == 11 else [])
        if psm == 11:
            return found
        return "\n".join(["block_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext", *(f"1\t1\t{i}\t5\t{i}\t9\t9\t90\t{t}" for i, t in enumerate(found))])

    def here(frame, run, schema):  # in this process, where the stand-ins are
        return spark.createDataFrame([tuple(r) for out in run([frame.toPandas()]) for r in out.itertuples(index=False)], schema)

    monkeypatch.setattr(adapters, "_need", lambda *_, **__: None)
    monkeypatch.setattr(adapters, "_read", read)
    monkeypatch.setattr(adapters, "_view_of", lambda content, view: content + b"+" + kinds[view].encode())
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", here)
    drawn = spark.createDataFrame([("A", 1, 160, bytearray(b"p1")), ("A", 2, 160, bytearray(b"p2"))], readers.RASTERS)
    images = spark.createDataFrame([("A", 1, 0, 800, 900, 3, bytearray(b"i0")), ("A", 1, 1, 900, 800, 3, bytearray(b"i1")), ("A", 2, 0, 900, 700, 3, bytearray(b"small")), ("A", 3, 0, 900, 900, 3, bytearray(b"else"))], readers.IMAGES)
    layer = spark.createDataFrame(cells(["ink"]), SPAN)
    found = folder.ocr_evidence(layer, drawn, images).orderBy("page", "ord").collect()
    assert [(r["page"], r["source"], r["text"]) for r in found] == [
        (1, "text_layer", "ink"), (1, "ocr:original", "Fee Receipt"), (1, "ocr:contrast_risk", "embargo notice"), (1, "ocr:fee_crop", "Fee Status: paid"), (1, "ocr:fee_psm11", "Status paid"),
        (1, "ocr:embedded_header", "left part"), (1, "ocr:embedded_header", "right part"), (1, "ocr:embedded_psm11", "sparse head"), (1, "ocr:embedded_mid_psm11", "sparse middle"), (2, "ocr:original", "active warrant"),
    ]
    assert not {c for c, _ in asked if c.startswith((b"p2+", b"small", b"else"))}
    assert {c for c, psm in asked if psm == 11} == {b"p1+FEE_LEVEL", b"i0+HEADER_LARGE", b"i1+HEADER_LARGE", b"i0+MID_LARGE", b"i1+MID_LARGE"}
    assert folder.ocr_evidence(layer, drawn.limit(0), images).count() == 1


def test_neural_reads_say_what_is_missing(spark) -> None:
    for module in ("rapidocr", "PIL"):
        if importlib.util.find_spec(module) is None:
            with pytest.raises(adapters.AdapterMissing):
                adapters.neural_reads(spark.createDataFrame([], readers.RASTERS))
            return


ROWS = [
    "FORM I-8090 Primary Intake", ("Applicant", "Ada Quill"), ("Species Code", "HUMAN"), ("Home World", "Kepler"), ("Visa Class", "XW-2"), ("Sponsor ID", "SPN-1234"),
    ("Arrival Date", "2026-03-01"), ("Declared Purpose", "research"), ("Fee Status", "paid"),
]


def test_pipeline_and_stream(spark, tmp_path) -> None:
    rows = cells([*ROWS, "Observed flags: none"]) + cells(ROWS, case="B")
    evidence = spark.createDataFrame(rows, SPAN)

    def decided(spans_):
        pages = spans_.groupBy("case_id", "page").agg(spans.joined(["ord"], separator="\n").alias("text"))
        return decide.emit(pipeline.run(spans_, pages))

    found = {r["case_id"]: r for r in decided(evidence).collect()}
    assert found["A"]["adjudication"] == "APPROVED" and found["A"]["risk_flags"] == "none" and found["A"]["sponsor_id"] == "SPN-1234"
    assert found["B"]["adjudication"] == "NEEDS_REVIEW"  # nothing clears its risk
    evidence.write.parquet(str(tmp_path / "in"))
    adjudicate_stream(readers.span_stream(spark, str(tmp_path / "in")), decided, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sinks.committed_records(spark, str(tmp_path / "out")).count() == 2


def test_hidden_ink_clears_unless_visibility_is_strict(spark) -> None:
    evidence = spark.createDataFrame(cells(ROWS), SPAN)
    pages = spark.createDataFrame([("A", 1, "Observed flags: none")], "case_id string, page int, text string")
    assert decide.emit(pipeline.run(evidence, pages)).first()["adjudication"] == "APPROVED"
    assert decide.emit(pipeline.run(evidence, pages, strict_visibility=True)).first()["adjudication"] == "NEEDS_REVIEW"


def test_no_approval_without_evidence(spark, sf) -> None:
    decided = decide.gates(decide.decide(repair.repair(catalog.wide(spark, sf)), fixtures.STALE), fixtures.STALE)
    approved = decided.where("adjudication = 'APPROVED'")
    by_hand = (F.col("manual") == "APPROVED") & ((F.col("manual_source") == "text_layer") | F.col("page_text").rlike("Finding: APPROVED"))
    bare = approved.where(~((F.col("risk_state") == "resolved") | F.coalesce(by_hand, F.lit(False)) | F.coalesce(F.col("gate") == "layout_consensus", F.lit(False))))
    assert approved.count() > 0 and bare.count() == 0


VALUE = st.sampled_from(["Ada Quill", "Ada Quil", "ADA QUILL", "Bo Tarn", "Cy"])
ROW = st.tuples(st.integers(1, 3), VALUE, st.sampled_from(["text_layer", "ocr:original", "manual_correction"]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(ROW, min_size=1, max_size=6), min_size=1, max_size=20), st.randoms())
def test_resolution_does_not_depend_on_row_order(spark, groups, random) -> None:
    rows = [(f"C{i}", "applicant_name", float(rank), value, source, j) for i, group in enumerate(groups) for j, (rank, value, source) in enumerate(group)]
    pick = lambda r: sorted(map(tuple, resolve.pick_fields(spark.createDataFrame(r, "case_id string, field string, rank double, value string, source string, at long")).collect()))
    mixed = rows[:]
    random.shuffle(mixed)
    assert pick(rows) == pick(mixed)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abc", max_size=5), st.text("abc", max_size=5)), min_size=1, max_size=40))
def test_near_duplicates_are_symmetric(spark, pairs) -> None:
    both = spark.createDataFrame(pairs, "a string, b string").select(resolve.near_duplicates(F.array("a", "b")).alias("x"), resolve.near_duplicates(F.array("b", "a")).alias("y"))
    assert all(r["x"] == r["y"] for r in both.collect())
