"""Column functions of the packet engine: text in, values out, all inside Catalyst.

Patterns carry explicit flags: ``U`` for Unicode classes, ``d`` so that only a
line feed ends a line. A missing match is null, not an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import vocab as V

ANY = "(?iUd)"
EXACT = "(?Ud)"


def matches(text: Column, pattern: str, flags: str = ANY) -> Column:
    return text.rlike(flags + pattern)


def capture(text: Column, pattern: str, group: int = 1, flags: str = ANY) -> Column:
    """First match's group; null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(text, flags + pattern, group), F.lit(""))


def captures(text: Column, pattern: str, group: int = 1, flags: str = ANY) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), group)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def exact_mean(value: Column) -> Column:
    """The mean of doubles, the same in whatever order and partitions they come: decimal sums lose nothing, and one rounding to twelve places hides the last bits."""
    return F.round(F.sum(value.cast("decimal(38,18)")).cast("double") / F.count(value), 12)


def first_letters(words: Iterable[str]) -> str:
    """First letters in either case (a long s folds to s), for a class that spares most places of a text the words themselves."""
    own = {x[0] for x in words}
    return "".join(sorted(own | {x.upper() for x in own})) + "\u017f"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    return F.lower(collapse(text))


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def only(values: Column) -> Column:
    """The value if the array has exactly one distinct one."""
    return let(F.array_distinct(values), lambda kinds: F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))))


def flag_array(*pairs: tuple[Column, str]) -> Column:
    """Sorted distinct names whose conditions hold."""
    named = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def encode_flags(flags: Column) -> Column:
    """Sorted, distinct, joined by ``|``; ``none`` if empty."""
    joined = F.array_join(F.array_sort(F.array_distinct(F.filter(flags, lambda x: x.isNotNull()))), "|")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("none"))


def decode_flags(text: Column) -> Column:
    return F.array_except(F.split(F.coalesce(text, F.lit("none")), r"\|"), F.array(F.lit(""), F.lit("none")))


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike(P.ISO_DAY) & (text >= "0001-01-01") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


# Canonical values


def fee(value: Column) -> Column:
    """Fee status of a phrase, or null: a whole word, else the token after a label, by typo table and stems."""

    def stem(token: Column) -> Column:
        stems = reduce(lambda out, s: F.when(F.startswith(token, F.lit(s[0])), s[1]).otherwise(out), reversed(V.FEE_STEMS), F.lit(None).cast("string"))
        return F.coalesce(lookup(token, V.FEE_TYPOS), stems)

    def of(folded: Column) -> Column:
        labelled = F.nullif(F.regexp_extract(folded, EXACT + V.FEE_LABEL + "([a-z]+)", 1), F.lit(""))
        token = F.coalesce(labelled, F.regexp_replace(folded, "[^a-z]", ""))
        return F.coalesce(capture(folded, P.FEE_WORD, flags=EXACT), let(token, stem))

    return let(fold(value), of)


def visa(value: Column) -> Column:
    exact = F.upper(F.trim(value))
    return F.when(exact.isin(*V.VISAS), exact).otherwise(lookup(F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", "")), V.VISA_TYPOS))


def date(value: Column) -> Column:
    """The first date-like token as ISO, if it is a real day and no marker says that it can't be read."""
    marked = any_of(*(F.contains(fold(value), F.lit(m)) for m in ("blank", "cut out", "illegible", "obscured", "unreadable")))
    shape = P.DAY
    iso = F.when(matches(value, shape, EXACT), F.concat_ws("-", *(F.regexp_extract(value, EXACT + shape, i) for i in (1, 2, 3))))
    return F.when(~marked & is_iso_date(iso), iso)




def name(value: Column) -> Column:
    """A person's name of two to four words, or null."""

    def of_tokens(text: Column, tokens: Column) -> Column:
        debris = (F.size(tokens) >= 2) & F.exists(F.slice(tokens, 3, 1_000), lambda t: (F.length(t) <= 2) & ~t.rlike(r"(?U)^\p{L}+$"))
        good = lambda words: F.size(words).between(2, 4) & F.forall(words, lambda t: t.rlike(P.NAME_WORD))
        first = F.slice(tokens, 1, 2)
        return F.when(debris, F.when(good(first), F.array_join(first, " "))).when(good(tokens), text)

    def of(text: Column) -> Column:
        bad = (F.length(text) < 3) | (F.length(text) > 48) | matches(text, P.NAME_PROSE) | matches(text, r"\d") | matches(text, P.NAME_BAD)
        tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
        return F.when(~bad, let(tokens, lambda words: of_tokens(text, words)))

    text = collapse(F.btrim(F.btrim(value), F.lit("|:;,-~=")))
    text = F.trim(F.regexp_replace(text, EXACT + P.NAME_TAIL, ""))
    return let(F.btrim(F.get(F.split(text, ANY + P.NAME_STOP, 2), F.lit(0)), F.lit(" |:;,-~=")), of)


def admissible(field: Column, value: Column) -> Column:
    """Whether a value may stand as evidence of a field."""
    folded = fold(value)
    marked = any_of(*(F.contains(folded, F.lit(m)) for m in ("blank", "cut out", "illegible", "obscured", "redacted")))
    other = ~marked & (folded != "unknown") & (folded != "") & ((field != "sponsor_id") | matches(F.trim(value), P.SPONSOR_SHAPE))
    return F.coalesce(F.when(field == "fee_status", fee(value).isNotNull()).when(field == "applicant_name", name(value).isNotNull()).otherwise(other), F.lit(False))


def canonical(field: Column, value: Column) -> Column:
    """The value as stored for a field, or null if it isn't admissible."""
    return (
        F.when(field == "fee_status", fee(value))
        .when(field == "visa_class", visa(value))
        .when(field == "arrival_date", date(value))
        .when(field == "applicant_name", name(value))
        .when(admissible(field, value), value)
    )


# Flags, findings, clearance


def flags(text: Column) -> Column:
    """Risk flags that a text names, misreadings repaired."""
    folded = F.translate(fold(text), "- ", "__")
    return let(folded, lambda x: flag_array(*((F.contains(x, F.lit(f)), f) for f in V.RISK_FLAGS), *((matches(text, p), f) for p, f in V.FLAG_REPAIRS)))


def layout_flags(text: Column) -> Column:
    """Risk flags as whole tokens of layout text."""
    tokens = F.concat(F.lit("_"), F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("_"))
    return let(tokens, lambda x: flag_array(*((F.contains(x, F.lit(f"_{f}_")), f) for f in V.RISK_FLAGS)))


def payload_flags(text: Column) -> Column:
    """Flags of every ``observed flags:`` payload; an unreadable one is a flag itself."""
    payloads = captures(text, P.OBSERVED)
    own = lambda p: F.when(matches(p, P.NONE) & (F.size(flags(p)) == 0), F.array().cast("array<string>")).otherwise(
        F.concat(flags(p), F.when(matches(p, P.UNREADABLE), F.array(F.lit("illegible_biometrics"))).otherwise(F.array().cast("array<string>")))
    )
    return F.array_sort(F.array_distinct(F.flatten(F.transform(payloads, own))))


def prose_flags(text: Column) -> Column:
    """Flags that a page says in prose."""
    return flag_array(
        (matches(text, P.RESCINDED), "rescinded_denial"),
        (matches(text, P.PANEL_MISSING) | matches(text, P.PURPOSE_ILLEGIBLE), "illegible_biometrics"),
    )


def page_flags(text: Column) -> Column:
    return F.array_sort(F.array_union(F.array_union(flags(text), payload_flags(text)), prose_flags(text)))


def finding(text: Column) -> Column:
    """The adjudicator's finding, typos repaired."""
    said = F.replace(F.upper(capture(text, P.FINDING)), F.lit(" "), F.lit("_"))
    return F.when(said == "DENED", "DENIED").when(said == "NEEDSREVIEW", "NEEDS_REVIEW").otherwise(said)


def cleared(text: Column) -> Column:
    """Whether a text says that there are no risk flags."""
    return F.coalesce(
        matches(text, P.CLEARED),
        F.lit(False),
    )


def source_rank(page_text: Column) -> Column:
    """Rank of a page by what its text says it is: 1 is the strongest."""
    text = F.lower(page_text)
    has = lambda *words: any_of(*(F.contains(text, F.lit(w)) for w in words))
    return (
        F.when(has("manual adjudicator", "manual finding"), 1)
        .when(has("form i-8090", "primary intake"), 2)
        .when(has("biometric"), 3)
        .when(has("sponsor") & has("attestation"), 4)
        .when(has("registry"), 5)
        .otherwise(6)
        .cast("int")
    )


# Lines


def decoy_span(text: Column) -> Column:

    def of(folded: Column) -> Column:
        return any_of(*(F.startswith(folded, F.lit(p)) for p in ("system:", "assistant:", "answer key"))) | F.contains(folded, F.lit("force approve"))

    return let(fold(text), of)


def trusted_line(line: Column) -> Column:

    def of(folded: Column) -> Column:
        prefixed = any_of(*(F.startswith(folded, F.lit(p)) for p in ("system:", "assistant:", "answer key", "user:")))
        return (folded != "") & ~prefixed & ~(F.contains(folded, F.lit("adjudication=")) & F.contains(folded, F.lit("risk_flags=")))

    return let(fold(line), of)


def clean_line(line: Column, prefix: str = "CASE") -> Column:
    """``trusted_line``, and neither an answer-key note nor a row of answers."""
    rows = rf"{re.escape(prefix)}-\d{{6}},.*,(APPROVED|DENIED|NEEDS_REVIEW)"
    return trusted_line(line) & ~matches(fold(line), P.ANSWER_KEY, EXACT) & ~matches(line, rows, EXACT)


def substantive_line(line: Column) -> Column:
    folded = fold(line)
    prefixed = any_of(*(F.startswith(folded, F.lit(p)) for p in ("packet ", "system:", "assistant:", "answer key")))
    return (folded != "") & ~prefixed & (folded != V.FOOTER)


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")


def kept_lines(text: Column, rule=trusted_line) -> Column:
    return F.array_join(F.filter(lines(text), rule), "\n")


def strip_injection(text: Column, prefix: str = "CASE") -> Column:
    return kept_lines(text, lambda line: clean_line(line, prefix))


def footer_only(text: Column) -> Column:
    return ~F.exists(lines(text), substantive_line)


# Layout


def fee_proven(text: Column) -> Column:
    return F.coalesce(matches(text, P.FEE_PROVEN), F.lit(False))


def layout_fee(text: Column) -> Column:
    """Fee status that receipt lines prove, or null."""
    zero = matches(text, P.ZERO_AMOUNT)
    waiver = matches(text, P.DIP_WAIVER) | matches(text, P.WAIVER_CODE)
    return (
        F.when(fee_proven(text) | matches(text, P.PAID_STATUS), "paid")
        .when((zero & waiver) | matches(text, P.WAIVED_STATUS), "waived")
    )


def person(raw: Column) -> Column:
    """First two capitalised words of a raw name, or null."""
    cut = F.trim(F.get(F.split(collapse(raw), EXACT + P.PERSON_CUT), F.lit(0)))
    parts = F.slice(F.split(cut, r"(?U)\s+"), 1, 2)
    return F.when((F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike(P.PERSON_WORD)), F.array_join(parts, " "))


def _people(text: Column, label: str) -> Column:
    raw = captures(text, label + P.PERSON, flags=EXACT)
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, person), lambda x: x.isNotNull())))


def registry_names(text: Column) -> Column:
    return _people(text, P.REGISTRY_LABEL)


def applicant_names(text: Column) -> Column:
    return _people(text, P.APPLICANT_LABEL)


def registry_matches(text: Column) -> Column:
    return let(registry_names(text), lambda x: (F.size(x) == 1) & (x == applicant_names(text)))


def layout_visas(text: Column) -> Column:
    found = F.transform(captures(text, P.LAYOUT_VISA), F.upper)
    return F.filter(found, lambda v: v.isin(*(x for x in V.VISAS if x != "TRANSIT-7")))


def layout_arrivals(text: Column) -> Column:
    return captures(text, P.LAYOUT_ARRIVAL)


def layout_worlds(text: Column) -> Column:
    found = F.transform(captures(text, P.LAYOUT_WORLD), collapse)
    found = F.filter(found, lambda w: (w != "") & ~matches(w, P.WORLD_BLEED))
    cut = F.transform(found, lambda w: F.trim(F.get(F.split(w, ANY + P.WORLD_CUT, 2), F.lit(0))))
    return F.filter(cut, lambda w: (w != "") & ~F.lower(w).isin("unknown", "n/a"))


def layout_species(text: Column) -> Column:
    found = captures(text, P.LAYOUT_SPECIES)
    return F.filter(F.transform(found, F.upper), lambda s: ~s.isin("CODE", "MATCH", "IMAGE"))


def attested_purpose(text: Column) -> Column:
    """Purpose of the last attestation that names a known one."""
    shape = P.ATTESTED_PURPOSE
    known = lambda said: F.coalesce(*(F.when(F.startswith(fold(said), F.lit(p)), p) for p in V.PURPOSES))
    hits = F.filter(F.transform(captures(text, shape), known), lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(-1))


def bound_purposes(text: Column, now: Column) -> Column:
    """Known purposes right after a label, but for the common default when that is what is there."""
    hit = lambda p: matches(text, rf"(?:declared\s+purpose\s*[:#.=_-]\s*{p}|purpose\s+of\s+visit\s*[:#.=_-]\s*{p})")
    return flag_array(*((hit(p) & ((now != p) if p == V.PURPOSES[0] else F.lit(True)), p) for p in V.PURPOSES))


# OCR texts


def rapid_fee(text: Column) -> Column:
    """Fee of the first line that tells one, else of the whole text."""

    def of_line(line: Column) -> Column:
        hinted = matches(line, P.RAPID_STATUS) | matches(line, P.RAPID_SUM, EXACT)
        return F.coalesce(
            F.when(hinted, F.nullif(fee(line), F.lit("unknown"))),
            F.when(matches(line, P.RAPID_PAID, EXACT), "paid"),
            F.when(matches(line, P.RAPID_ZERO, EXACT), "waived"),
        )

    return F.coalesce(F.get(F.filter(F.transform(lines(text), of_line), lambda x: x.isNotNull()), F.lit(0)), F.nullif(fee(text), F.lit("unknown")))


def rapid_visa(text: Column) -> Column:
    of_line = lambda line: visa(capture(line, P.RAPID_VISA_LINE))
    first = F.get(F.filter(F.transform(lines(text), of_line), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first, visa(capture(text, P.RAPID_VISA)))


def signals(text: Column) -> dict[str, Column]:
    """What a page's text signals about risk, for analysis."""
    folded = F.lower(text)
    hints = flag_array(
        (matches(folded, r"active\s*warrant", EXACT), "active_warrant"),
        (matches(folded, r"biohazard|bichazard", EXACT), "biohazard_red"),
        (matches(folded, r"memory\s*tamper", EXACT), "memory_tampering"),
        (matches(folded, r"illegible\s*biometric|b-13", EXACT), "illegible_biometrics"),
    )
    return {
        "cleared": matches(text, P.SIGNAL_CLEARED),
        "has_b13": F.contains(folded, F.lit("b-13")) | F.contains(folded, F.lit("biometric")),
        "has_registry_clear": matches(folded, r"\bclear\b", EXACT),
        "hard_flag_hints": F.array_join(hints, "|"),
        "has_sample_denial": F.contains(folded, F.lit("sample denial")),
        "has_finding": matches(folded, r"\bfinding\s*:", EXACT),
    }
