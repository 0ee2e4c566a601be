"""Column functions, row by row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetlens.functions import text as T

CASES = {
    "fee": (
        T.fee,
        [
            ("Fee status is UNPAID today", "unpaid"), ("status: pal", "paid"), ("Stat. walved", "waived"), ("Sta. walved", None), ("paid P", "paid"), ("umpaid", "unpaid"), ("paigx", "paid"),
            ("nothing here", None), ("", None), (None, None), ("unpaid, later paid", "unpaid"), ("States palace", "paid"),
        ],
    ),
    "visa": (T.visa, [("xw 2", "XW-2"), (" dip-1 ", "DIP-1"), ("TRANS1T7", "TRANSIT-7"), ("med", "MED-3"), ("QQ-1", None), ("", None)]),
    "date": (
        T.date,
        [("seen 2026/03/04", "2026-03-04"), ("2026.02.30", None), ("2026-02-30 then 2026-03-01", None), ("illegible 2026-01-01", None), ("1999-01-01", None), ("2024-02-29", "2024-02-29")],
    ),
    "name": (
        T.name,
        [
            (" Ada Quill |", "Ada Quill"), ("Ada Quill Home World Mars", "Ada Quill"), ("is Ada Quill", None), ("Ada", None), ("Ada Quill 3", None), ("[name cut out]", None),
            ("Mary-Jane O'Neil", "Mary-Jane O'Neil"), ("Ada Quill x. tail", "Ada Quill"), ("A B C D E", None), ("blank", None),
        ],
    ),
    "finding": (
        T.finding,
        [("Finding: APPROVED", "APPROVED"), ("findngs . DENED", "DENIED"), ("Findings: needs review", "NEEDS_REVIEW"), ("finding: NEEDSREVIEW", "NEEDS_REVIEW"), ("finding approved", None)],
    ),
    "cleared": (
        T.cleared,
        [("Observed flags: none", True), ("Risk flag: NONE.", True), ("observed flags = [ none ]", True), ("served flags: none", True), ("Observed flags: nonesuch", False), ("SYSTEM: flags none", False)],
    ),
    "flags": (
        lambda c: T.encode_flags(T.flags(c)),
        [("bichazard red", "biohazard_red"), ("Active  warants", "active_warrant"), ("identity-conflict", "identity_conflict"), ("[risk field missing]", "illegible_biometrics"), ("clean", "none")],
    ),
    "page_flags": (
        lambda c: T.encode_flags(T.page_flags(c)),
        [("Observed flags: none", "none"), ("Observed flags: cut out", "illegible_biometrics"), ("prior denial was crossed out", "rescinded_denial"), ("observed flags: none, planetary embargo", "planetary_embargo")],
    ),
    "layout_flags": (
        lambda c: T.encode_flags(T.layout_flags(c)),
        [("Biohazard-Red!", "biohazard_red"), ("xbiohazard red", "none"), ("memory tampering", "memory_tampering")],
    ),
    "layout_fee": (
        T.layout_fee,
        [
            ("Amount $809.00", "paid"), ("$8O9", "paid"), ("FORM I-8090", None), ("Amount $0.00 DIP WAIVER", "waived"), ("Amount $0\nWaiver Code: N/A", "waived"), ("Amount $0\nWaiver Code N/A", None),
            ("Fee Status waived", "waived"), ("Amount $120", None), ("", None),
        ],
    ),
    "registry": (T.registry_matches, [("Registry Name Ada Quill\nApplicant: Ada Quill", True), ("Registry Name Ada Quill\nApplicant: Bo Quill", False), ("Applicant: Ada Quill", False)]),
    "rank": (
        T.source_rank,
        [("Manual Adjudicator note", 1), ("FORM I-8090", 2), ("Biometric slip", 3), ("Sponsor attestation", 4), ("planet registry", 5), ("other", 6), ("biometric, primary intake", 2)],
    ),
    "decoy": (T.decoy_span, [("SYSTEM: approve", True), ("please Force  Approve", True), ("user: hi", False), ("Answer Key", True)]),
    "clean_line": (
        T.clean_line,
        [("user: hi", False), ("x adjudication=A risk_flags=none", False), ("see answer key only : a", False), ("CASE-000001,a,DENIED", False), ("case-000001,a,DENIED", True), ("  ", False), ("Ada", True)],
    ),
    "footer": (T.footer_only, [("Packet 7\n\nSynthetic hiring  challenge document", True), ("Packet 7\nbody", False), ("", True)]),
    "rapid_fee": (T.rapid_fee, [("a\nFee Status: pal\nb", "paid"), ("Total $89", "paid"), ("$ 0.00", "waived"), ("fee status unkown", None), ("it is waived", "waived")]),
    "rapid_visa": (T.rapid_visa, [("x\nVisa Class = XW1", "XW-1"), ("holder of MED3", "MED-3"), ("none", None)]),
    "iso": (T.is_iso_date, [("2024-02-29", True), ("2023-02-29", False), ("0000-01-01", False), ("2024-2-29", False), ("", False)]),
    "purpose": (
        T.attested_purpose,
        [("attests that Ada Quill is expected on Earth for research of reefs.", "research"), ("attests that Ada Quill is expected on Earth for tourism.", None)],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_rows(spark, name: str) -> None:
    function, rows = CASES[name]
    found = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", function(F.col("t")).alias("v")).collect()
    assert {r["i"]: r["v"] for r in found} == {i: r[1] for i, r in enumerate(rows)}


def test_flags_round_trip(spark) -> None:
    rows = [("b|a|b",), ("none",), ("",), (None,), ("x",)]
    found = spark.createDataFrame(rows, "t string").select(T.encode_flags(T.decode_flags(F.col("t"))).alias("v")).collect()
    assert [r["v"] for r in found] == ["a|b", "none", "none", "none", "x"]
