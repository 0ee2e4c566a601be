"""The catalogue's queries in DuckDB SQL."""

from __future__ import annotations

from packetlens.functions import vocab as V
from packetlens.operators import analysis

from . import duck as D
from .fixtures import STALE, with_clause


def over(fixture: str | tuple[str, ...], sql: str, extra: str = "") -> str:
    """A query over fixtures, with further CTEs in ``extra``."""
    names = (fixture,) if isinstance(fixture, str) else fixture
    return with_clause(*names) + (f", {extra}" if extra else "") + f" {sql}"


def _adjudicated(source: str) -> str:
    return f"a AS (SELECT *, CASE WHEN {D.hard()} THEN 'hard_denial' ELSE {D.reason(stale=STALE)} END AS reason FROM {source})"


_PLAIN = "p AS (SELECT k, case_id, applicant_name, species_code, home_world, declared_purpose, risk_flags, " + D.record() + " FROM packets)"

# Pages of spans, with rank
_PG = f"pg AS (SELECT *, {D.rank('text')} AS rank FROM page_text)"
_LABEL = {label: field for field, labels in V.LABELS.items() for label in labels}
_FIELD = D.case(f"rtrim({D.fold('text')}, ':')", _LABEL)
_CORRECTION = r"\bmanual correction\s*:\s*(applicant|sponsor|species( code)?|home world|visa class|arrival date|declared purpose|fee status)\s+is\s+([^.|]+)"


def _labelled() -> str:
    parts = []
    for field, labels in V.LABELS.items():
        for label in labels:
            found = D.ext("text", rf"\b{label}\s*:\s*([^|]+)$")
            parts.append(f"SELECT case_id, page, ord, '{field}' AS field, {D.collapse(found)} AS value FROM spans WHERE {found} IS NOT NULL AND NOT {D.rx('text', r'\bmanual correction\s*:')}")
    return " UNION ALL ".join(parts)


def _glued() -> str:
    tail = {
        "sponsor_id": r"\s*:?\s*(SPN[- ]?\d{4})\b",
        "visa_class": r"\s*:?\s*([A-Za-z]+[- ]?\d)\b",
        "arrival_date": r"\s*:?\s*(20\d{2}[-./]\d{2}[-./]\d{2})\b",
        "species_code": r"\s*:?\s*([A-Z][A-Z_]+)\b",
    }
    parts = []
    for field, labels in V.LABELS.items():
        pattern = V.FEE_LABEL + r"([A-Za-z]+(?:\s+[A-Za-z])?)\b" if field == "fee_status" else f"(?:{'|'.join(labels)})" + tail.get(field, r"\s*:?\s*(.+)$")
        found = D.ext("text", pattern)
        parts.append(f"SELECT case_id, page, ord, '{field}' AS field, {D.collapse(found)} AS value FROM spans WHERE {found} IS NOT NULL AND NOT {D.rx('text', r'\bmanual correction\s*:')}")
    return " UNION ALL ".join(parts)


_DAY = r"\b(20\d{2}[-./]\d{2}[-./]\d{2})\b"
_AT = "regexp_extract(substr(concat(' ', text), i, 10), '^\\W(SPN[- ]?\\d{4})(\\W|$)', 1, 'i')"
_NEAR = f"lower(substr(text, greatest(1, i - 48), i - greatest(1, i - 48) + length({_AT}) + 12))"
_SPN = f"list_transform(list_filter(range(1, length(text) + 1), lambda i: {_AT} <> '' AND NOT {D.has(_NEAR, 'system:', 'answer key', 'ignore visible')}), lambda i: concat('SPN-', right({_AT}, 4)))"
_AMOUNT = f"try_cast({D.ext('text', r'\bamount\s*\$?\s*(\d+(\.\d{2})?)')} AS decimal(20,2))"
_WAIVER = f"upper({D.ext('text', r'\bwaiver code\s*[:]?\s*(N/A|[A-Z0-9_-]+)')})"
_LIKE = D.rx("text", r"\bm[il1]b\s+fe[eag]\s+receipt\b|\bfee\s+receipt\b")
_GATE = f"({_LIKE} OR contains(lower(text), 'waiver code') OR {D.rx('text', r'\$\s*809\b', 'c')})"

# Conflict resolution
_PICK = f"""
n AS (SELECT *, {D.fold("value")} AS norm, row_number() OVER (PARTITION BY case_id, field ORDER BY rank, a1, a2, a3, a4, a5, a6, value, source) AS o FROM candidates),
b AS (SELECT *, min(rank) OVER (PARTITION BY case_id, field) AS best FROM n),
g AS (
  SELECT case_id, field, min(rank) AS best_rank,
    count(DISTINCT norm) FILTER (WHERE rank = best) AS kinds,
    count(DISTINCT norm) FILTER (WHERE rank = best AND source = 'text_layer') AS trusted,
    count(DISTINCT norm) FILTER (WHERE source = 'text_layer') AS trusted_all,
    bool_or(source = 'manual_correction') AS corrected,
    min_by([value, source], o) FILTER (WHERE rank = best) AS first_,
    min_by([value, source], o) FILTER (WHERE rank = best AND source = 'text_layer') AS first_trusted,
    list(DISTINCT norm) FILTER (WHERE rank = best) AS norms,
    max_by(value, concat(lpad(cast(length(value) AS varchar), 6, '0'), value)) FILTER (WHERE rank = best) AS longest,
    min_by(norm, concat(lpad(cast(length(norm) AS varchar), 6, '0'), norm)) FILTER (WHERE rank = best) AS shortest
  FROM b GROUP BY case_id, field),
l AS (SELECT b.case_id, b.field, min_by([b.value, b.source], o) FILTER (WHERE b.value = g.longest) AS first_longest, min_by([b.value, b.source], o) FILTER (WHERE b.norm = g.shortest) AS first_shortest
  FROM b JOIN g USING (case_id, field) WHERE b.rank = b.best GROUP BY 1, 2),
near AS (
  SELECT case_id, field, bool_and(x >= y OR (abs(length(x) - length(y)) <= 2 AND length(x) >= 2 AND length(y) >= 2 AND levenshtein(x, y) <= 2)) AS near
  FROM (SELECT case_id, field, unnest(norms) AS x, norms FROM g) a, LATERAL (SELECT unnest(a.norms) AS y) z GROUP BY 1, 2),
picked AS (
  SELECT g.*, CASE WHEN kinds = 1 THEN first_ WHEN trusted = 1 THEN first_trusted WHEN field = 'applicant_name' AND near THEN first_longest
    WHEN field IN ('species_code', 'home_world', 'visa_class', 'declared_purpose') AND length(shortest) >= 3
      AND len(list_filter(norms, lambda v: NOT (v = shortest OR starts_with(v, shortest || ' ')))) = 0 THEN first_shortest END AS chosen
  FROM g JOIN l USING (case_id, field) JOIN near USING (case_id, field)),
done AS (
  SELECT case_id, field, chosen[1] AS value, chosen[2] AS source, cast(best_rank AS double) AS best_rank,
    CASE WHEN CASE WHEN kinds > 1 THEN chosen IS NULL ELSE NOT corrected AND trusted_all > 1 END
      THEN CASE field WHEN 'applicant_name' THEN 'identity_conflict' WHEN 'sponsor_id' THEN 'sponsor_mismatch' END END AS conflict
  FROM picked)
"""

# Wide packets with their proof text
_LIST = "CASE WHEN risk_flags = 'none' THEN [] ELSE string_split(risk_flags, '|') END"
_W = f"w AS (SELECT *, {_LIST} AS flags, {D.strip('layout_raw')} AS layout_text FROM wide)"
_PROOF = f"pr AS (SELECT *, array_to_string(list_filter([layout_text, {D.strip('page_text')}, {D.strip('all_text')}], lambda z: z <> ''), chr(10)) AS proof FROM w)"
_OPEN = "{0}_state = 'unknown'"

_REG, _APP = D.only(D.registries("proof")), D.only(D.applicants("proof"))
_VISAS = f"list_filter(list_transform({D.every('proof', r'responsibility for class\s+([A-Z0-9\-]+)\s+compliance')}, lambda v: upper(v)), lambda v: v IN ('XW-1', 'XW-2', 'DIP-1', 'MED-3'))"
_WORLDS = (
    f"list_filter(list_transform(list_filter(list_transform({D.every('proof', r'Home\s+World\s*[:#]?\s*([A-Za-z][A-Za-z0-9 \-\x27]{1,40})')}, lambda v: {D.collapse('v')}), "
    f"lambda v: v <> '' AND NOT {D.rx('v', 'visa|sponsor|species|arrival|registry')}), lambda v: trim(regexp_replace(v, '\\s+(Species|Visa|Sponsor|Arrival|Declared|Fee)\\b.*$', '', 'i'))), "
    "lambda v: v <> '' AND lower(v) NOT IN ('unknown', 'n/a'))"
)
_SPECIES = f"list_filter(list_transform({D.every('proof', r'(?:Species\s+(?:Code|Match)|Species)\s*[:#]?\s*([A-Z][A-Z0-9_\-]{3,30})')}, lambda v: upper(v)), lambda v: v NOT IN ('CODE', 'MATCH', 'IMAGE'))"
_ATT = D.only(D.every("proof", r"Sponsor\s+(SPN-\d{4})\s+attests"))
_REV = D.only(D.every("proof", r"Revoked sponsor:\s*(SPN-\d{4})"))
_KNOWN = "CASE " + " ".join(f"WHEN starts_with({D.fold('v')}, '{p}') THEN '{p}'" for p in V.PURPOSES) + " END"
_ATTEST = (
    f"list_filter(list_transform({D.every('proof', r'attests that [A-Z][a-z]+(?:\s+[A-Z][a-z]+)+ is expected on Earth for ([a-z \n]+?)(?:\.|,|\n\n)')}, lambda v: {_KNOWN}), lambda z: z IS NOT NULL)[-1]"
)
_BOUND = D.names(
    *(
        (D.rx("proof", rf"(declared\s+purpose\s*[:#.=_-]\s*{p}|purpose\s+of\s+visit\s*[:#.=_-]\s*{p})") + (f" AND lower(declared_purpose) <> '{p}'" if p == V.PURPOSES[0] else ""), p)
        for p in V.PURPOSES
    )
)


def _fill(field: str, found: str) -> str:
    return f"CASE WHEN ({_OPEN.format(field)} OR {D.unknown(field)}) THEN {D.only(found)} END"


_PICKS = {
    "fee_status": f"CASE WHEN {_OPEN.format('fee_status')} OR lower(fee_status) = 'unknown' OR (lower(fee_status) = 'unpaid' AND {D.layout_fee('proof')} = 'paid' AND {D.proven('proof')}) THEN {D.layout_fee('proof')} END",
    "applicant_name": (
        f"CASE WHEN {D.unknown('applicant_name')} OR (trim(applicant_name) <> coalesce({_REG}, {_APP}) AND ({_OPEN.format('applicant_name')} OR {D.weak('applicant_name_source')} "
        f"OR coalesce({_REG} = {_APP}, false))) THEN coalesce({_REG}, {_APP}) END"
    ),
    "visa_class": _fill("visa_class", _VISAS),
    "arrival_date": _fill("arrival_date", D.every("proof", r"Arrival\s+Date\s+(\d{4}-\d{2}-\d{2})")),
    "home_world": _fill("home_world", _WORLDS),
    "species_code": _fill("species_code", _SPECIES),
    "sponsor_id": (
        f"(SELECT CASE WHEN {_OPEN.format('sponsor_id')} OR sponsor_id IN ('SPN-0000', 'unknown', '') OR ({D.weak('sponsor_id_source')} AND sponsor_id <> x.pick) THEN x.pick END FROM (SELECT coalesce({_REV}, "
        f"CASE WHEN sponsor_id IN ('SPN-0000', 'unknown', '') OR (regexp_matches(sponsor_id, '^SPN-\\d{{4}}$') AND substr(sponsor_id, 1, 7) = substr({_ATT}, 1, 7) AND sponsor_id <> {_ATT}) THEN {_ATT} END) AS pick) x)"
    ),
    "declared_purpose": (
        f"CASE WHEN {_ATTEST} IS NOT NULL AND ({_OPEN.format('declared_purpose')} OR lower(declared_purpose) = 'unknown' OR (lower(declared_purpose) = 'reactor maintenance' AND {_ATTEST} <> lower(declared_purpose))) "
        f"THEN {_ATTEST} WHEN {_OPEN.format('declared_purpose')} OR lower(declared_purpose) IN ('unknown', 'reactor maintenance') THEN {D.only(_BOUND)} END"
    ),
}


def _repair(field: str) -> str:
    return over(
        "wide",
        f"SELECT case_id, coalesce(pick, {field}) AS {field}, CASE WHEN pick IS NOT NULL THEN 'layout_text' ELSE {field}_source END AS source, pick IS NOT NULL AS repaired FROM (SELECT *, {_PICKS[field]} AS pick FROM pr)",
        f"{_W}, {_PROOF}",
    )


# Decisions over wide packets
_RISK = "CASE WHEN len(flags) > 0 THEN array_to_string(flags, '|') WHEN risk_state = 'resolved' THEN coalesce(risk_value, 'none') ELSE 'none' END"
_TRUSTED = f"(coalesce(manual = 'APPROVED', false) AND (coalesce(manual_source = 'text_layer', false) OR {D.rx('page_text', r'\bfinding\s*:\s*APPROVED\b')}))"
_DECIDE = f"""
d0 AS (SELECT * REPLACE (CASE WHEN manual IS NOT NULL THEN risk_flags ELSE {_RISK} END AS risk_flags), {_TRUSTED} AS trusted FROM {{source}}),
d1 AS (SELECT *, CASE WHEN {D.hard()} THEN 'hard_denial' ELSE {D.reason(stale=STALE)} END AS r0 FROM d0),
d2 AS (SELECT *, {D.decided("r0")} AS a0,
   coalesce(sponsor_id_source = 'sponsor_attestation', false) OR coalesce(visa_class_source = 'sponsor_attestation', false) AS attested,
   coalesce(species_code_source = 'text_layer' AND home_world_source = 'text_layer' AND arrival_date_source = 'text_layer', false) AS intake,
   risk_state = 'resolved' AND coalesce(risk_value = 'none' AND risk_source = 'text_layer', false) AS clear,
   coalesce(manual = 'APPROVED', false) AND risk_state <> 'resolved' AND NOT trusted AS stopped FROM d1),
d3 AS (SELECT *, CASE WHEN manual IS NOT NULL AND stopped THEN 'NEEDS_REVIEW' WHEN manual IS NOT NULL THEN manual
     WHEN a0 = 'APPROVED' AND attested AND NOT intake AND NOT clear THEN 'NEEDS_REVIEW' WHEN a0 = 'APPROVED' AND risk_state <> 'resolved' AND NOT trusted THEN 'NEEDS_REVIEW' ELSE a0 END AS adjudication,
   CASE WHEN manual IS NOT NULL AND stopped THEN 'finding_without_risk' WHEN manual IS NOT NULL THEN 'manual_finding'
     WHEN a0 = 'APPROVED' AND attested AND NOT intake AND NOT clear THEN 'attestation_only' WHEN a0 = 'APPROVED' AND risk_state <> 'resolved' AND NOT trusted THEN 'unresolved_risk' ELSE r0 END AS reason FROM d2),
d AS (SELECT *, CASE WHEN manual IS NOT NULL AND NOT stopped THEN 0.94::DOUBLE ELSE {D.level("adjudication")} END AS confidence, CAST(NULL AS VARCHAR) AS gate FROM d3)
"""
_PEND = "adjudication = 'NEEDS_REVIEW' AND len(flags) = 0 AND arrival_date NOT IN ('1900-01-01', 'unknown', '')"
_CP = f"array_to_string(list_filter([layout_text, {D.strip('page_text')}], lambda z: z <> ''), chr(10))"
_HARD = ", ".join(map(D.q, V.HARD_FLAGS))
_CLEAN = f"""
c0 AS (SELECT *, {_CP} AS cp FROM d),
c1 AS (SELECT *, coalesce({_PEND} AND {D.cleared("page_text")} AND NOT list_has_any({D.layout_flags("cp")}, [{_HARD}])
   AND ((fee_status = 'paid' AND (coalesce({D.layout_fee("cp")} = 'paid', false) OR {D.proven("cp")})) OR (fee_status = 'waived' AND coalesce({D.layout_fee("cp")} <> 'paid', contains(lower(cp), 'waiv'))))
   AND NOT {D.hard("'none'")} AND {D.reason("'none'", STALE)} = 'no_override', false) AS opens FROM c0),
c AS (SELECT * EXCLUDE (opens, cp) REPLACE (CASE WHEN opens THEN 'APPROVED' ELSE adjudication END AS adjudication, CASE WHEN opens THEN 0.68::DOUBLE ELSE confidence END AS confidence,
   CASE WHEN opens THEN 'clean_packet' END AS gate, CASE WHEN opens THEN 'resolved' ELSE risk_state END AS risk_state, CASE WHEN opens THEN 'none' ELSE risk_value END AS risk_value,
   CASE WHEN opens THEN 'layout_clearance' ELSE risk_source END AS risk_source, CASE WHEN opens THEN 'none' ELSE risk_flags END AS risk_flags) FROM c1)
"""
_REV6 = ", ".join(map(D.q, V.REVOKED))
_FP = f"array_to_string(list_filter([layout_text, {D.strip('page_text')}, {D.strip('all_text')}], lambda z: z <> ''), chr(10))"
_CONS = f"""
e0 AS (SELECT *, {_FP} AS fp FROM {{source}}),
e1 AS (SELECT *, coalesce({_PEND} AND visa_class IN ('DIP-1', 'XW-2') AND fee_status = 'paid' AND risk_flags IN ('', 'none')
   AND NOT (lower(home_world) IN ('trappist-1e', 'eris relay') OR (lower(home_world) = 'wolf-1061c' AND visa_class <> 'DIP-1')) AND lower(declared_purpose) <> 'medical consult'
   AND (visa_class = 'DIP-1' OR sponsor_id NOT IN ('SPN-0000', 'UNKNOWN', '', {_REV6})) AND {D.proven("fp")} AND len({D.registries("fp")}) = 1 AND {D.registries("fp")} = {D.applicants("fp")}
   AND len({D.layout_flags("fp")}) = 0 AND {D.decided(D.reason("'none'", STALE))} <> 'DENIED', false) AS opens FROM e0),
e AS (SELECT * EXCLUDE (opens, fp) REPLACE (CASE WHEN opens THEN 'APPROVED' ELSE adjudication END AS adjudication, CASE WHEN opens THEN 0.65::DOUBLE ELSE confidence END AS confidence,
   CASE WHEN opens THEN 'layout_consensus' ELSE gate END AS gate) FROM e1)
"""
_REPAIRED = (
    "rp0 AS (SELECT *, " + ", ".join(f"{sql} AS {f}_pick" for f, sql in _PICKS.items()) + " FROM pr), "
    "rp1 AS (SELECT * REPLACE (" + ", ".join(f"coalesce({f}_pick, {f}) AS {f}, CASE WHEN {f}_pick IS NOT NULL THEN 'resolved' ELSE {f}_state END AS {f}_state, "
    f"CASE WHEN {f}_pick IS NOT NULL THEN 'layout_text' ELSE {f}_source END AS {f}_source" for f in _PICKS) + ") FROM rp0), "
    "rp AS (SELECT rp1.* REPLACE (" + D.record() + ") FROM rp1)"
)
_EMIT_RISK = _RISK

_CASE_TEXTS = "ct AS (SELECT case_id, string_agg(text, ' ' ORDER BY page, ord) AS text FROM spans GROUP BY case_id)"
_OCR_LINES = f"""
ww AS (SELECT *, trim(text) AS word, try_cast(conf AS double) / 100 AS cf, try_cast("left" AS int) AS x0, try_cast(top AS int) AS y0, try_cast("left" AS int) + try_cast(width AS int) AS x1,
  try_cast(top AS int) + try_cast(height AS int) AS y1 FROM words),
ln AS (SELECT case_id, page_num, block_num, par_num, line_num, string_agg(word, ' ' ORDER BY x0, t1, t2, t3, word) AS text, round({D.exact_mean('cf')}, 6) AS confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM ww WHERE word <> '' AND cf >= 0 AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL GROUP BY ALL)
"""
_RISKWORD = D.has("lower(text)", "biohazard", "warrant", "tampering", "embargo", "rescind", "illegible")
_SIGNALS = {
    "cleared": D.some(D.rx("text", r"observed flags?\s*:\s*none\b"), D.rx("text", r"\brisk flags?\s*:\s*none\b")),
    "has_b13": D.has("lower(text)", "b-13", "biometric"),
    "has_registry_clear": D.rx("lower(text)", r"\bclear\b", "c"),
    "hard_flag_hints": "array_to_string("
    + D.names(
        (D.rx("lower(text)", r"active\s*warrant"), "active_warrant"),
        (D.rx("lower(text)", "biohazard|bichazard"), "biohazard_red"),
        (D.rx("lower(text)", r"memory\s*tamper"), "memory_tampering"),
        (D.rx("lower(text)", r"illegible\s*biometric|b-13"), "illegible_biometrics"),
    )
    + ", '|')",
    "has_sample_denial": D.has("lower(text)", "sample denial"),
    "has_finding": D.rx("lower(text)", r"\bfinding\s*:", "c"),
}
_MISSING_PAGES = f"""
mean AS (SELECT DISTINCT case_id, page FROM spans WHERE size >= 8 AND NOT starts_with(text, 'Packet ') AND {D.fold("text")} <> '{V.FOOTER}'),
foot AS (SELECT case_id, page FROM page_text WHERE len(list_filter(string_split(text, chr(10)), lambda l: {D.body_line("l")})) = 0),
img AS (SELECT DISTINCT case_id, page FROM images WHERE greatest(width, height) >= 800),
todo AS (SELECT case_id, page FROM page_text EXCEPT SELECT case_id, page FROM mean UNION SELECT case_id, page FROM foot UNION SELECT case_id, page FROM img)
"""

_LAYOUT = ("case_id", "applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", f"{_EMIT_RISK} AS risk_flags", "fee_status", "adjudication", "confidence")
_LAID_OUT = f"{_W}, {_PROOF}, {_REPAIRED}, {_DECIDE.replace('{source}', 'rp')}, {_CLEAN}, {_CONS.replace('{source}', 'c')}"
_FLAT_FLAGS = D.names(*((f"contains(replace(replace(lower(text), '-', '_'), ' ', '_'), {D.q(f)})", f) for f in V.RISK_FLAGS))


def _blank(field: str) -> str:
    return D.q(V.BLANK[field]) if isinstance(V.BLANK[field], str) else f"{V.BLANK[field]}::DOUBLE"


def _flat(label: str) -> str:
    return rf"{label}\s*[:#-]\s*(.+?)(?:\s+(?:{analysis.NEXT_LABEL})\s*[:#-]|$)"


def _all_candidates() -> str:
    """Every candidate: what spans and pages give, with ranks and steps, admissible values in canonical form."""
    plain = f"NOT {D.rx('text', r'\bmanual correction\s*:')}"
    sponsor, purpose = D.ext("text", r"\bsponsor\s+(SPN[- ]?\d{4})\s+attests\b"), D.collapse(D.ext("text", r"\bexpected on earth for\s+([a-z][a-z ]+?)(?:\.|$)"))
    applicant, visa = D.collapse(D.ext("text", r"\battests that\s+([^.]*)\s+is expected on earth\b")), D.ext("text", r"\bclass\s+([A-Za-z]+[- ]?\d)\s+compliance\b")
    status = f"CASE WHEN {_GATE} THEN CASE WHEN {_AMOUNT} = 0 AND {_WAIVER} <> 'N/A' THEN 'waived' WHEN {_AMOUNT} > 0 AND {_WAIVER} = 'N/A' THEN 'paid' END END"
    fallback = f"CASE WHEN {_GATE} AND {_WAIVER} IS NULL AND {_LIKE} AND {D.rx('text', r'\$\s*0(\.00)?\b', 'c')} THEN 'waived' END"
    by_span = [
        f"SELECT case_id, page, ord, {_FIELD} AS field, cell AS value, source, 1 AS step FROM celled WHERE {plain} AND NOT contains({D.fold('cell')}, 'sample denial')",
        f"SELECT x.*, source, 2 FROM ({_labelled()}) x JOIN spans USING (case_id, page, ord)",
        f"SELECT x.*, source, 3 FROM ({_glued()}) x JOIN spans USING (case_id, page, ord)",
        f"SELECT case_id, page, ord, {D.case(D.fold(D.ext('text', _CORRECTION)), V.CORRECTED)}, {D.collapse(D.ext('text', _CORRECTION, 3))}, 'manual_correction', 4 FROM spans",
        f"SELECT case_id, page, ord, 'sponsor_id', {sponsor}, 'sponsor_attestation', 5 FROM spans",
        f"SELECT case_id, page, ord, 'declared_purpose', {purpose}, 'sponsor_attestation', 6 FROM spans",
    ]
    by_page = [
        ("sponsor_id", V.ATTEST_OFFSET, sponsor, "sponsor_attestation"),
        ("declared_purpose", V.ATTEST_OFFSET, purpose, "sponsor_attestation"),
        ("applicant_name", V.ATTEST_OFFSET, applicant, "sponsor_attestation"),
        ("visa_class", V.ATTEST_OFFSET, visa, "sponsor_attestation"),
        ("sponsor_id", V.SPONSOR_TOKEN_OFFSET, D.only(_SPN), "sponsor_token"),
        ("arrival_date", V.DATE_TOKEN_OFFSET, f"CASE WHEN len({D.every('text', _DAY)}) = 1 THEN {D.every('text', _DAY)}[1] END", "date_token"),
        ("fee_status", V.RECEIPT_OFFSET, status, "receipt_amount_waiver"),
        ("waiver_code", V.RECEIPT_OFFSET, f"CASE WHEN {_GATE} AND {_WAIVER} <> 'N/A' THEN {_WAIVER} END", "receipt_waiver_code"),
        ("fee_status", V.RECEIPT_FALLBACK_OFFSET, fallback, "receipt_amount_fallback"),
    ]
    pages = " UNION ALL ".join(
        f"SELECT case_id, page, 2000000000 AS ord, '{field}' AS field, {value} AS value, '{source}' AS source, {step} AS step, rank + CASE WHEN ocr_only THEN {V.OCR_OFFSET} ELSE 0 END + ({offset}) AS rank FROM pg"
        for step, (field, offset, value, source) in enumerate(by_page, 7)
    )
    bad = D.has(D.fold("value"), "blank", "cut out", "illegible", "obscured", "redacted")
    other = f"NOT {bad} AND {D.fold('value')} NOT IN ('unknown', '') AND (field <> 'sponsor_id' OR {D.rx('trim(value)', r'^SPN[- ]?\d{4}$')})"
    judged = f"CASE field WHEN 'fee_status' THEN {D.fee('value')} WHEN 'visa_class' THEN {D.visa('value')} WHEN 'arrival_date' THEN {D.date('value')} WHEN 'applicant_name' THEN {D.name('value')} ELSE CASE WHEN {other} THEN value END END"
    order = "lpad(cast(cast((r.x0 - l.x1) * 100 AS bigint) AS varchar), 9, '0') || lpad(cast(cast(r.x0 * 100 AS bigint) AS varchar), 9, '0') || lpad(cast(r.ord AS varchar), 9, '0')"
    extra = [
        _PG,
        f"cells AS (SELECT l.case_id, l.page, l.ord, arg_min(r.text, {order}) AS cell FROM spans l JOIN spans r ON l.case_id = r.case_id AND l.page = r.page AND abs(r.y0 - l.y0) <= greatest(7.0, l.size) "
        f"AND r.x0 >= l.x1 + greatest(15.0, (l.x1 - l.x0) * 0.25) AND r.text <> l.text WHERE {_FIELD.replace('text', 'l.text')} IS NOT NULL GROUP BY 1, 2, 3)",
        "celled AS (SELECT * FROM cells JOIN spans USING (case_id, page, ord))",
        f"by_span AS ({' UNION ALL '.join(by_span)})",
        f"ranked AS (SELECT b.*, CASE WHEN step = 4 THEN {V.CORRECTION_RANK} ELSE rank + CASE WHEN starts_with(s.source, 'ocr:') THEN {V.OCR_OFFSET} ELSE 0 END END AS rank "
        "FROM by_span b JOIN spans s USING (case_id, page, ord) JOIN (SELECT case_id, page, rank FROM pg) p USING (case_id, page))",
        f"every AS (SELECT case_id, page, ord, field, value, source, step, rank FROM ranked UNION ALL {pages})",
        f"judged AS (SELECT case_id, field, CAST(rank AS DOUBLE) AS rank, {judged} AS value, source, page, ord, step FROM every WHERE field IS NOT NULL AND value IS NOT NULL)",
    ]
    return over(("spans", "page_text"), "SELECT * FROM judged WHERE value IS NOT NULL", ", ".join(extra))


ORACLES: dict[str, str] = {
    "adjudicate_packets": over(
        "packets",
        f"SELECT case_id, applicant_name, home_world, visa_class, sponsor_id, arrival_date, fee_status, risk_flags, reason, {D.decided('reason')} AS adjudication, {D.level(D.decided('reason'))} AS confidence FROM a",
        f"{_PLAIN}, {_adjudicated('p')}",
    ),
    "policy_reason_counts": over("packets", f"SELECT {D.reason(stale=STALE)} AS reason, count(*) AS n FROM p GROUP BY 1", _PLAIN),
    "normalize_records": over("dirty", f"SELECT case_id, {D.record()} FROM (SELECT case_id, visa AS visa_class, sponsor AS sponsor_id, substr(day, 1, 10) AS arrival_date, fee AS fee_status FROM dirty)"),
    "blank_record_defaults": "SELECT concat('CUST-', cast(c_custkey AS string)) AS case_id, "
    + ", ".join(f"coalesce({'max(o_orderstatus)' if f == 'fee_status' else 'NULL'}, {D.q(b) if isinstance(b, str) else f'{b}::DOUBLE'}) AS {f}" for f, b in V.BLANK.items())
    + " FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "visible_spans": over("spans", "SELECT case_id, page, ord, text FROM spans WHERE color <> 16777215 AND size >= 6"),
    "inside_spans": over(("spans", "pages_dim"), "SELECT s.case_id, s.page, s.ord, s.text FROM spans s JOIN pages_dim d USING (case_id, page) WHERE x0 >= -1 AND y0 >= -1 AND x1 <= width + 1 AND y1 <= height + 1"),
    "decoy_spans": over("spans", f"SELECT case_id, page, ord, text FROM spans WHERE {D.starts(D.fold('text'), 'system:', 'assistant:', 'answer key')} OR contains({D.fold('text')}, 'force approve')"),
    "trusted_lines": over("line_pages", f"SELECT conv_id, turn, {D.kept('text', D.trusted_line)} AS text FROM line_pages"),
    "strip_injection": over("line_pages", f"SELECT conv_id, turn, {D.strip('text')} AS text FROM line_pages"),
    "footer_only_pages": over("page_text", "SELECT case_id, page FROM foot", "x AS (SELECT 1), " + _MISSING_PAGES.replace("FROM images", "FROM (SELECT '' AS case_id, 0 AS page, 0 AS width, 0 AS height)")),
    "meaningful_pages": over("spans", f"SELECT DISTINCT case_id, page FROM spans WHERE size >= 8 AND NOT starts_with(text, 'Packet ') AND {D.fold('text')} <> '{V.FOOTER}'"),
    "pages_to_ocr": over(("page_text", "images"), "SELECT case_id, page FROM todo", _MISSING_PAGES),
    "audit_pages": over(
        ("page_text", "images", "wide"),
        "SELECT m.case_id, m.page FROM m JOIN (SELECT case_id, bool_or(hit) AS any_hit FROM m GROUP BY 1) x ON m.case_id = x.case_id WHERE need OR NOT any_hit OR hit",
        _MISSING_PAGES
        + ", chosen AS (SELECT case_id, page FROM todo UNION SELECT case_id, page FROM images UNION SELECT case_id, page FROM page_text WHERE "
        + D.has("lower(text)", *V.AUDIT_WORDS)
        + "), m AS (SELECT p.case_id, p.page, w.risk_state = 'unknown' AS need, c.page IS NOT NULL AS hit FROM page_text p JOIN wide w ON p.case_id = w.case_id LEFT JOIN chosen c ON p.case_id = c.case_id AND p.page = c.page)",
    ),
    "ocr_words_to_lines": over("words", "SELECT * FROM ln", _OCR_LINES),
    "page_mean_confidence": over("words", f"SELECT case_id, page_num, round({D.exact_mean('confidence')}, 6) AS confidence FROM ln GROUP BY 1, 2", _OCR_LINES.replace(f"round({D.exact_mean('cf')}, 6)", D.exact_mean("cf"))),
    "contrast_retry": over(
        ("spans", "packets"),
        f"SELECT case_id, page, ord, text FROM spans s WHERE source = 'ocr:original' AND confidence >= 0.35 AND {_RISKWORD} AND NOT EXISTS (SELECT 1 FROM spans_b b WHERE b.case_id = s.case_id AND b.page = s.page AND {_RISKWORD.replace('text', 'b.text')})".replace(
            "FROM spans s", "FROM spans_c s"
        ),
        "spans_c AS (SELECT *, cast(k % 10 AS double) / 10 AS confidence FROM spans), spans_b AS (SELECT * FROM spans WHERE source <> 'ocr:original' OR ord < 3)",
    ),
    "fee_crop_pages": over(
        "spans",
        f"SELECT case_id, page FROM (SELECT case_id, page, string_agg(text, ' ' ORDER BY y0, x0, text) AS t, bool_or({D.fee('text')} IS NOT NULL) AS readable FROM spans GROUP BY 1, 2) WHERE {D.rx('lower(t)', r'fe[eag]\s+receipt|fee\s+stat', 'c')} AND NOT readable",
    ),
    "distinct_ocr_texts": over(
        "words",
        "SELECT case_id, page_num, string_agg(t, chr(10) ORDER BY at_, t) AS text FROM (SELECT case_id, page_num, trim(text) AS said, min(crop) AS at_, arg_min(text, crop) AS t FROM r WHERE trim(text) <> '' GROUP BY ALL) GROUP BY 1, 2",
        "r AS (SELECT case_id, page_num, text, min(t1) AS crop FROM words GROUP BY 1, 2, 3)",
    ),
    "all_candidates": _all_candidates(),
    "same_line_value": over(
        "spans",
        "SELECT l.case_id, l.page, l.ord, arg_min(r.text, lpad(cast(cast((r.x0 - l.x1) * 100 AS bigint) AS varchar), 9, '0') || lpad(cast(cast(r.x0 * 100 AS bigint) AS varchar), 9, '0') || lpad(cast(r.ord AS varchar), 9, '0')) AS value "
        f"FROM spans l JOIN spans r ON l.case_id = r.case_id AND l.page = r.page AND abs(r.y0 - l.y0) <= greatest(7.0, l.size) AND r.x0 >= l.x1 + greatest(15.0, (l.x1 - l.x0) * 0.25) AND r.text <> l.text WHERE {_FIELD.replace('text', 'l.text')} IS NOT NULL GROUP BY 1, 2, 3",
    ),
    "label_value_pairs": over("spans", _labelled()),
    "glued_rows": over("spans", _glued()),
    "manual_corrections": over(
        "spans",
        f"SELECT case_id, page, ord, {D.case(D.fold(D.ext('text', _CORRECTION)), V.CORRECTED)} AS field, {D.collapse(D.ext('text', _CORRECTION, 3))} AS value FROM spans WHERE {D.rx('text', _CORRECTION)}",
    ),
    "attestation_fields": over(
        "page_text",
        f"SELECT case_id, page, {D.ext('text', r'\bsponsor\s+(SPN[- ]?\d{4})\s+attests\b')} AS sponsor_id, {D.collapse(D.ext('text', r'\bexpected on earth for\s+([a-z][a-z ]+?)(?:\.|$)'))} AS declared_purpose, "
        f"{D.collapse(D.ext('text', r'\battests that\s+([^.]*)\s+is expected on earth\b'))} AS applicant_name, {D.ext('text', r'\bclass\s+([A-Za-z]+[- ]?\d)\s+compliance\b')} AS visa_class FROM page_text",
    ),
    "token_fallbacks": over(
        "page_text",
        f"SELECT case_id, page, {D.only(_SPN)} AS sponsor_id, CASE WHEN len({D.every('text', _DAY)}) = 1 THEN {D.every('text', _DAY)}[1] END AS arrival_date FROM page_text",
    ),
    "receipt_fees": over(
        "page_text",
        f"SELECT case_id, page, CASE WHEN {_GATE} THEN CASE WHEN {_AMOUNT} = 0 AND {_WAIVER} <> 'N/A' THEN 'waived' WHEN {_AMOUNT} > 0 AND {_WAIVER} = 'N/A' THEN 'paid' END END AS status, "
        f"CASE WHEN {_GATE} AND {_WAIVER} IS NULL AND {_LIKE} AND {D.rx('text', r'\$\s*0(\.00)?\b', 'c')} THEN 'waived' END AS fallback, CASE WHEN {_GATE} AND {_WAIVER} <> 'N/A' THEN {_WAIVER} END AS code FROM page_text",
    ),
    "page_flags": over("dirty", f"SELECT case_id, {D.pipes(D.page_flags('risk'))} AS flags, {D.cleared('risk')} AS cleared FROM dirty"),
    "manual_findings": over("dirty", f"SELECT case_id, {D.finding('note')} AS finding FROM dirty"),
    "source_rank_pages": over("page_text", "SELECT case_id, page, cast(rank AS int) AS rank FROM pg", _PG),
    "canon_fee": over("dirty", f"SELECT case_id, fee AS raw, {D.fee('fee')} AS fee FROM dirty"),
    "canon_name": over("dirty", f"SELECT case_id, name AS raw, {D.name('name')} AS name FROM dirty"),
    "canon_visa": over("dirty", f"SELECT case_id, visa AS raw, {D.visa('visa')} AS visa FROM dirty"),
    "canon_date": over("dirty", f"SELECT case_id, day AS raw, {D.date('day')} AS day FROM dirty"),
    "recover_flags": over("dirty", f"SELECT case_id, {D.pipes(D.flags('risk'))} AS flags FROM dirty"),
    "layout_flags": over("dirty", f"SELECT case_id, {D.pipes(D.layout_flags('risk'))} AS flags FROM dirty"),
    "encode_flags": over("packets", f"SELECT c, {D.pipes("list_sort(list_distinct(flatten(list(CASE WHEN risk_flags = 'none' THEN [] ELSE string_split(risk_flags, '|') END))))")} AS flags FROM packets GROUP BY c"),
    "best_rank_candidates": over("candidates", "SELECT case_id, field, value, source, cast(rank AS double) AS rank FROM b WHERE rank = best", _PICK),
    "pick_fields": over("candidates", "SELECT * FROM done", _PICK),
    "field_conflicts": over("candidates", "SELECT conflict, count(*) AS n FROM done WHERE conflict IS NOT NULL GROUP BY 1", _PICK),
    "near_duplicate_names": over("candidates", "SELECT case_id, field, near FROM near", _PICK),
    "scalar_evidence": over(
        "wide",
        "SELECT case_id, CASE WHEN lower(fee_status) IN ('', 'unknown') THEN 'unknown' ELSE 'resolved' END AS fee_status, CASE WHEN upper(visa_class) IN ('', 'UNKNOWN') THEN 'unknown' ELSE 'resolved' END AS visa_class, "
        "CASE WHEN sponsor_id IN ('', 'SPN-0000') AND nullif(sponsor_id_source, 'ocr') IS NULL THEN 'unknown' ELSE 'resolved' END AS sponsor_id, CASE WHEN arrival_date IN ('', '1900-01-01') AND nullif(arrival_date_source, 'ocr') IS NULL THEN 'unknown' ELSE 'resolved' END AS arrival_date, "
        "CASE WHEN lower(home_world) = 'unknown' AND nullif(home_world_source, 'ocr') IS NULL THEN 'unknown' ELSE 'resolved' END AS home_world FROM wide",
    ),
    "risk_evidence": over(
        "wide",
        f"SELECT case_id, CASE WHEN len(flags) > 0 OR cl THEN 'resolved' ELSE 'unknown' END AS state, CASE WHEN len(flags) > 0 THEN array_to_string(flags, '|') WHEN cl THEN 'none' END AS value, CASE WHEN len(flags) > 0 OR cl THEN coalesce(risk_source, 'text_layer') ELSE risk_source END AS source FROM (SELECT *, {D.cleared('page_text')} AS cl FROM w)",
        _W,
    ),
    "rapid_parse": over(
        "ocr_texts", f"SELECT case_id, {D.rapid_fee('text')} AS fee_status, {D.rapid_visa('text')} AS visa_class, {D.pipes(D.flags('text'))} AS risk_flags, {D.cleared('text')} AS cleared FROM ocr_texts WHERE stage = 'rapid'"
    ),
    "gap_fill_merge": over(
        ("wide", "ocr_texts"),
        "SELECT case_id, CASE WHEN uf THEN rf ELSE fee_status END AS fee_status, CASE WHEN uf THEN 'rapidocr' ELSE fee_status_source END AS fee_status_source, CASE WHEN uv THEN rv ELSE visa_class END AS visa_class, "
        "CASE WHEN uv THEN 'rapidocr' ELSE visa_class_source END AS visa_class_source, CASE WHEN fl OR cl2 THEN 'resolved' ELSE risk_state END AS risk_state, CASE WHEN fl THEN array_to_string(af, '|') WHEN cl2 THEN 'none' ELSE risk_value END AS risk_value, "
        "CASE WHEN fl OR cl2 THEN 'rapidocr' ELSE risk_source END AS risk_source, CASE WHEN fl THEN array_to_string(af, '|') WHEN cl2 THEN 'none' ELSE risk_flags END AS risk_flags FROM (SELECT *, open_ AND cl AND len(af) = 0 AS cl2 FROM m)",
        f"{_W}, j AS (SELECT w.*, CASE WHEN 'unknown' IN (fee_status_state, visa_class_state, risk_state) THEN o.text END AS t FROM w JOIN ocr_texts o ON w.case_id = o.case_id AND o.stage = 'rapid'), "
        f"pa AS (SELECT *, {D.rapid_fee('t')} AS rf, {D.rapid_visa('t')} AS rv, {D.flags('t')} AS f2, {D.cleared('t')} AS cl, risk_state = 'unknown' AS open_ FROM j), "
        "m AS (SELECT *, fee_status_state = 'unknown' AND rf IS NOT NULL AND coalesce(fee_status_source, '') <> 'text_layer' AS uf, visa_class_state = 'unknown' AND rv IS NOT NULL AND coalesce(visa_class_source, '') <> 'text_layer' AS uv, "
        "open_ AND len(f2) > 0 AS fl, CASE WHEN open_ AND len(f2) > 0 THEN list_sort(list_distinct(list_concat(flags, f2))) ELSE flags END AS af FROM pa)",
    ),
    "fee_boost_merge": over(
        ("wide", "ocr_texts"),
        "SELECT case_id, coalesce(x, fee_status) AS fee_status, CASE WHEN x IS NOT NULL THEN 'resolved' ELSE fee_status_state END AS fee_status_state, CASE WHEN x IS NOT NULL THEN 'rapidocr' ELSE fee_status_source END AS fee_status_source FROM m",
        f"m AS (SELECT w.*, CASE WHEN fee_status_state = 'unknown' OR lower(fee_status) = 'unknown' THEN coalesce({D.rapid_fee('o.text')}, {D.layout_fee('o.text')}) END AS x FROM wide w JOIN ocr_texts o ON w.case_id = o.case_id AND o.stage = 'boost')",
    ),
    "forensic_merge": over(
        ("wide", "ocr_texts"),
        "SELECT case_id, CASE WHEN fl OR cl THEN 'resolved' ELSE risk_state END AS risk_state, CASE WHEN fl THEN array_to_string(f2, '|') WHEN cl THEN 'none' ELSE risk_value END AS risk_value, CASE WHEN fl OR cl THEN 'forensic_ocr' ELSE risk_source END AS risk_source, "
        "CASE WHEN fl THEN array_to_string(f2, '|') WHEN cl THEN 'none' ELSE risk_flags END AS risk_flags FROM (SELECT *, risk_state = 'unknown' AND len(f2) > 0 AS fl, risk_state = 'unknown' AND len(f2) = 0 AND c0 AS cl FROM m)",
        f"m AS (SELECT w.*, {D.flags('o.text')} AS f2, {D.cleared('o.text')} AS c0 FROM wide w JOIN ocr_texts o ON w.case_id = o.case_id AND o.stage = 'forensic')",
    ),
    **{f"repair_{f}": _repair(f) for f in _PICKS},
    "decide_packets": over("wide", "SELECT case_id, adjudication, confidence, reason FROM d", f"{_W}, {_DECIDE.replace('{source}', 'w')}"),
    "clean_packet_gate": over("wide", "SELECT case_id, adjudication, confidence, gate, risk_source FROM c", f"{_W}, {_DECIDE.replace('{source}', 'w')}, {_CLEAN}"),
    "consensus_gate": over("wide", "SELECT case_id, adjudication, confidence, gate FROM e", f"{_W}, {_DECIDE.replace('{source}', 'w')}, {_CONS.replace('{source}', 'd')}"),
    "pipeline_layout": over("wide", f"SELECT {', '.join(_LAYOUT)} FROM e", _LAID_OUT),
    "folder_to_records": over(
        "wide",
        "SELECT case_id, " + ", ".join(f"CASE WHEN right(case_id, 1) = '7' THEN {_blank(f)} ELSE coalesce({f}, {_blank(f)}) END AS {f}" for f in V.BLANK) + f" FROM (SELECT {', '.join(_LAYOUT)} FROM e)",
        _LAID_OUT,
    ),
    "emit_jsonl": over("wide", f"SELECT case_id, to_json(struct_pack({', '.join(f'{f} := {f}' for f in sorted(['case_id', *V.BLANK]))}))::VARCHAR AS line FROM (SELECT {', '.join(_LAYOUT)} FROM e)", _LAID_OUT),
    "oracle_pages": over(("page_text", "images"), "SELECT DISTINCT p.case_id, p.page FROM page_text p LEFT JOIN images i ON p.case_id = i.case_id AND p.page = i.page WHERE p.page = 1 OR i.case_id IS NOT NULL"),
    "first_miss_ids": over(
        "predictions",
        "SELECT t.case_id FROM truth t JOIN predictions p ON t.case_id = p.case_id WHERE t.adjudication = 'APPROVED' AND p.adjudication = 'NEEDS_REVIEW' AND "
        + " AND ".join(f"lower(coalesce(p.{k}, '')) = lower(coalesce(t.{k}, ''))" for k in ("risk_flags", "fee_status", "visa_class", "sponsor_id", "species_code", "home_world"))
        + " ORDER BY 1 LIMIT 40",
    ),
    "alt_extract": over(
        "page_text",
        "SELECT case_id, risk_flags, " + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in (*analysis.TOKENS, *analysis.FLAT_LABELS)) + " FROM fl LEFT JOIN (SELECT * FROM rk WHERE k = 1) USING (case_id) GROUP BY ALL",
        f"fl AS (SELECT case_id, {D.pipes('list_sort(list_distinct(flatten(list(' + _FLAT_FLAGS + '))))')} AS risk_flags FROM page_text GROUP BY case_id), "
        "c AS ("
        + " UNION ALL ".join(
            [
                f"SELECT case_id, page, ocr_only, '{f}' AS field, upper(unnest({D.every('text', p, 0)})) AS value, generate_subscripts({D.every('text', p, 0)}, 1) AS place FROM page_text"
                for f, p in analysis.TOKENS.items()
            ]
            + [
                f"SELECT case_id, page, ocr_only, '{f}' AS field, coalesce({', '.join(D.collapse(D.ext('text', _flat(x))) for x in labels)}) AS value, 0 AS place FROM page_text"
                for f, labels in analysis.FLAT_LABELS.items()
            ]
        )
        + "), rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, field ORDER BY ocr_only, -(1.0 / page), page, place) AS k FROM c WHERE value IS NOT NULL)",
    ),
    "packet_slice": over("packets", "SELECT case_id, visa_class FROM packets ORDER BY case_id LIMIT 500 OFFSET 100"),
    "case_list_join": over("packets", "SELECT pos, case_id, visa_class, fee_status FROM packets JOIN (SELECT o_orderkey AS ok, 1000000000000 - o_orderkey AS pos FROM orders) x ON k = ok"),
    "pure_miss_ids": over(
        "predictions",
        "SELECT t.case_id FROM truth t JOIN predictions p ON t.case_id = p.case_id WHERE t.adjudication = 'APPROVED' AND p.adjudication = 'NEEDS_REVIEW' AND "
        + " AND ".join(f"lower(coalesce(p.{k}, '')) = lower(coalesce(t.{k}, ''))" for k in ("risk_flags", "fee_status", "visa_class", "sponsor_id", "species_code", "home_world")),
    ),
    "risk_signals": over("page_text", "SELECT case_id, page, " + ", ".join(f"{sql} AS {n}" for n, sql in _SIGNALS.items()) + " FROM page_text"),
    "signal_summary": over(
        "page_text",
        "SELECT count(*) AS n, count(*) FILTER (WHERE c) AS any_cleared, count(*) FILTER (WHERE b) AS any_b13, count(*) FILTER (WHERE NOT c AND NOT b) AS neither FROM "
        f"(SELECT case_id, bool_or({_SIGNALS['cleared']}) AS c, bool_or({_SIGNALS['has_b13']}) AS b FROM page_text GROUP BY 1)",
    ),
    "confusion_matrix": over("predictions", "SELECT t.adjudication AS truth, p.adjudication AS predicted, count(*) AS n FROM truth t JOIN predictions p ON t.case_id = p.case_id GROUP BY 1, 2"),
    "calibration_bins": over(
        "predictions",
        f"SELECT cast(least(floor(confidence * 10), 9) AS int) AS bin, count(*) AS n, round({D.exact_mean('confidence')}, 6) AS mean_confidence, round(avg(CASE WHEN t.adjudication = p.adjudication THEN 1.0 ELSE 0.0 END), 6) AS share_right FROM truth t JOIN predictions p ON t.case_id = p.case_id GROUP BY 1",
    ),
    "training_cohort": over(
        ("truth", "rasters"),
        "SELECT case_id, n, label FROM it WHERE label = 1 UNION ALL SELECT case_id, n, label FROM (SELECT *, row_number() OVER (ORDER BY md5(case_id), width, height, n) AS pos FROM it WHERE label = 0) WHERE pos <= (SELECT 3 * count(*) FROM it WHERE label = 1)",
        f"lb AS (SELECT case_id, CASE WHEN list_has_any(string_split(risk_flags, '|'), [{', '.join(map(D.q, V.TRAINING_HARD_FLAGS))}]) THEN 1 WHEN adjudication = 'APPROVED' AND risk_flags = 'none' THEN 0 END AS label FROM truth), "
        "it AS (SELECT * FROM (SELECT r.*, label, row_number() OVER (PARTITION BY r.case_id ORDER BY width, height, n) AS pick FROM rasters r JOIN lb ON r.case_id = lb.case_id WHERE label IS NOT NULL AND least(width, height) >= 200 AND channels >= 3) WHERE pick <= 3)",
    ),
    "page_set_algebra": over(
        ("page_text", "images"), "SELECT case_id, count(*) FILTER (WHERE t) AS todo, count(*) FILTER (WHERE NOT t) AS covered FROM (SELECT p.case_id, x.page IS NOT NULL AS t FROM page_text p LEFT JOIN todo x ON p.case_id = x.case_id AND p.page = x.page) GROUP BY 1", _MISSING_PAGES
    ),
    "sha256_verify": "SELECT concat('doc-', cast(doc_id AS string)) AS path, sha256(text) = sha256(CASE WHEN lang = 'en' THEN text ELSE concat(text, 'x') END) AS ok FROM documents",
    "case_texts": over("spans", "SELECT case_id, text FROM ct", _CASE_TEXTS),
}
