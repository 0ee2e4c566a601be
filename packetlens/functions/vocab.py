"""Closed vocabularies, typo tables and constants of the packet engine: data only."""

from __future__ import annotations

# Output fields, in the order in which records are declared.
RECORD_FIELDS = (
    "case_id", "applicant_name", "species_code", "home_world", "visa_class", "sponsor_id",
    "arrival_date", "declared_purpose", "risk_flags", "fee_status", "adjudication", "confidence",
)
SCALARS = (
    "applicant_name", "species_code", "home_world", "visa_class",
    "sponsor_id", "arrival_date", "declared_purpose", "fee_status",
)

# What a record holds where nothing is known.
BLANK = {
    "applicant_name": "unknown",
    "species_code": "unknown",
    "home_world": "unknown",
    "visa_class": "unknown",
    "sponsor_id": "SPN-0000",
    "arrival_date": "1900-01-01",
    "declared_purpose": "unknown",
    "risk_flags": "none",
    "fee_status": "unknown",
    "adjudication": "NEEDS_REVIEW",
    "confidence": 0.01,
}

# Labels of each field on a form, in matching order.
LABELS = {
    "applicant_name": ("applicant", "registry name"),
    "species_code": ("species code", "species match"),
    "home_world": ("home world",),
    "visa_class": ("visa class",),
    "sponsor_id": ("sponsor id",),
    "arrival_date": ("arrival date",),
    "declared_purpose": ("declared purpose",),
    "fee_status": ("fee status",),
}

# Risk flags.
HARD_FLAGS = ("active_warrant", "biohazard_red", "memory_tampering", "planetary_embargo")
REVIEW_FLAGS = ("identity_conflict", "illegible_biometrics", "rescinded_denial", "sponsor_mismatch")
RISK_FLAGS = tuple(sorted(HARD_FLAGS + REVIEW_FLAGS))
# The hard set of the training cohort has a fifth flag.
TRAINING_HARD_FLAGS = (*HARD_FLAGS, "illegible_biometrics")

# Patterns of misread flags.
FLAG_REPAIRS = (
    (r"bi[co0]hazard[_\s-]*red", "biohazard_red"),
    (r"\bbichazard\b", "biohazard_red"),
    (r"active[_\s-]*warr?ants?", "active_warrant"),
    (r"planetary[_\s-]*embargo", "planetary_embargo"),
    (r"memory[_\s-]*tamper\w*", "memory_tampering"),
    (r"illegible[_\s-]*bio\w*", "illegible_biometrics"),
    (r"risk\s*panel\s*missing", "illegible_biometrics"),
    (r"\[risk[^\]]*missing\]", "illegible_biometrics"),
    (r"sponsor[_\s-]*mismatch", "sponsor_mismatch"),
    (r"rescind\w*", "rescinded_denial"),
)

# Fee words and their misreadings.
FEES = ("paid", "waived", "unpaid", "unknown")
FEE_TYPOS = {
    "sumpaid": "unpaid",
    "umpaid": "unpaid",
    "unpaicl": "unpaid",
    "unpaic": "unpaid",
    "unkown": "unknown",
    "unkonwn": "unknown",
    "waivod": "waived",
    "waivcd": "waived",
    "unved": "waived",
    "waiv": "waived",
    "waved": "waived",
    "walved": "waived",
    "waivled": "waived",
    "pac": "paid",
    "pag": "paid",
    "pal": "paid",
    "pai": "paid",
    "paig": "paid",
    "paicl": "paid",
    "paic": "paid",
    "paid": "paid",
    "waived": "waived",
    "unpaid": "unpaid",
    "unknown": "unknown",
}
FEE_STEMS = (
    ("unpaid", "unpaid"), ("waiv", "waived"), ("unved", "waived"), ("waved", "waived"), ("paid", "paid"),
    ("paig", "paid"), ("pal", "paid"), ("unknown", "unknown"), ("unkown", "unknown"),
)
FEE_LABEL = r"(?:fee\s*)?stat[a-z]*\s*[:.|]?\s*"

# Visa classes and their misreadings without punctuation.
VISAS = ("XW-1", "XW-2", "DIP-1", "MED-3", "TRANSIT-7")
VISA_TYPOS = {
    "XW1": "XW-1", "XW2": "XW-2", "XWI": "XW-1", "XWE1": "XW-1", "XWE2": "XW-2",
    "MED3": "MED-3", "MED": "MED-3", "DIP1": "DIP-1", "DIP": "DIP-1",
    "TRANSIT7": "TRANSIT-7", "TRANSIT": "TRANSIT-7", "TRANST7": "TRANSIT-7", "TRAMSIT7": "TRANSIT-7", "TRANS1T7": "TRANSIT-7",
}

# Purposes, in matching order.
PURPOSES = (
    "reactor maintenance", "field repair", "medical consult", "research", "cultural exchange",
    "translation", "archive audit", "xenobotany", "diplomatic", "transit",
)

# Sponsors and worlds that deny.
POLICY_REVOKED = ("SPN-0007", "SPN-0139", "SPN-4040")
REVOKED = (*POLICY_REVOKED, "SPN-9090", "SPN-7331", "SPN-2718")
EMBARGO_WORLDS = ("trappist-1e", "eris relay")
CONDITIONAL_WORLD = "wolf-1061c"
STALE_BEFORE = "2026-01-02"

# Field names in corrections.
CORRECTED = {
    "applicant": "applicant_name",
    "sponsor": "sponsor_id",
    "species": "species_code",
    "species code": "species_code",
    "home world": "home_world",
    "visa class": "visa_class",
    "arrival date": "arrival_date",
    "declared purpose": "declared_purpose",
    "fee status": "fee_status",
}

# Confidences.
CONFIDENCE = {"APPROVED": 0.72, "DENIED": 0.91, "NEEDS_REVIEW": 0.41}
MANUAL_CONFIDENCE = 0.94
CLEAN_CONFIDENCE = 0.68
CONSENSUS_CONFIDENCE = 0.65
CONSENSUS_VISAS = ("DIP-1", "XW-2")

# Ranks (hundredths are exact in decimals) and offsets.
OCR_OFFSET = "3.00"
CORRECTION_RANK = "1.50"
ATTEST_OFFSET = "-0.05"
RECEIPT_OFFSET = "-0.10"
RECEIPT_FALLBACK_OFFSET = "0.20"
SPONSOR_TOKEN_OFFSET = "0.50"
DATE_TOKEN_OFFSET = "0.60"

# Thresholds.
WHITE = 16777215
MIN_SIZE, MEANINGFUL_SIZE = 6.0, 8.0
OCR_CONFIDENCE, RETRY_CONFIDENCE = 0.25, 0.35
BAND_SIDE, IMAGE_SIDE, FORENSIC_SIDE, TRAINING_SIDE = 800, 800, 900, 200
FOOTER = "synthetic hiring challenge document"
AUDIT_WORDS = ("fee status", "fee receipt", "observed flag", "risk flag", "b-13", "biometric", "form b13", "visa class")
