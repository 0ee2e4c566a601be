"""Candidate values of fields: one long relation from spans and page texts.

A candidate row: case_id, field, rank (decimal, smaller is stronger), value,
source, and ``at``, the order in which candidates of equal rank are preferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import patterns as P
from packetlens.functions import text as T
from packetlens.functions import vocab as V
from packetlens.lineage import settle

from .spans import page_texts, right_cells

RANK = "decimal(6,2)"
LAST = 2_000_000_000

_GLUED = {
    "sponsor_id": P.GLUED_SPONSOR,
    "visa_class": P.GLUED_VISA,
    "arrival_date": P.GLUED_DAY,
    "species_code": P.GLUED_SPECIES,
}


def _dec(value: str) -> Column:
    return F.lit(value).cast(RANK)


def label_of(text: Column) -> Column:
    """Field whose label a span is, or null."""
    said = F.rtrim(T.fold(text), F.lit(":"))
    return T.lookup(said, {label: field for field, labels in V.LABELS.items() for label in labels})


def is_correction(text: Column) -> Column:
    return T.matches(text, P.CORRECTION_LINE)


_LABELS = [(label, field) for field, labels in V.LABELS.items() for label in labels]
_ANY_LABEL = "|".join(sorted((label for label, _ in _LABELS), key=len, reverse=True))

#: Labels begin with one of these; a misread fee label as the fee label does, or with its second word.
_FIRST = T.first_letters([*(label for label, _ in _LABELS), "stat"])


def has_label(text: Column) -> Column:
    """Whether a span holds any label at all; without one ``label_heads`` finds none."""
    return T.matches(text, f"{_ANY_LABEL}|{V.FEE_LABEL}")


def label_heads(text: Column) -> Column:
    """One pass over a text: for each place where a label begins, in order, the label's number, its field, and the value behind it in either form.

    ``pair`` is what ``label: value`` at the end of a text gives, ``glued`` the
    value of a form row read as one line, with or without a colon. The pattern
    looks ahead from each place, so places may overlap; each is told with the
    character before it, which a line feed stands for at the text's begin.
    """
    number = {label: str(i) for i, (label, _) in enumerate(_LABELS)}
    after = lambda head, labels, value: T.collapse(T.capture(head, rf"^(?s:.)(?:{labels}){value}"))

    def told(head: Column, label: Column, field: Column) -> Column:
        glued = after(head, _ANY_LABEL, P.GLUED_ANY)
        for name, pattern in _GLUED.items():
            glued = F.when(field == name, after(head, "|".join(V.LABELS[name]), pattern)).otherwise(glued)
        glued = F.when(field == "fee_status", T.collapse(T.capture(head, rf"^(?s:.){V.FEE_LABEL}{P.GLUED_FEE}"))).otherwise(glued)
        pair = F.when(F.contains(head, F.lit(":")), T.collapse(T.capture(head, rf"^\W(?:{_ANY_LABEL})\s*:\s*([^|]+)$")))
        return F.struct(T.lookup(label, number).cast("int").alias("label"), field.alias("field"), pair.alias("pair"), glued.alias("glued"))

    def of(head: Column) -> Column:
        label = F.lower(F.regexp_extract(head, rf"{T.ANY}^(?s:.)({_ANY_LABEL})", 1))
        field = lambda x: F.coalesce(T.lookup(x, dict(_LABELS)), F.lit("fee_status"))
        return T.let(label, lambda x: T.let(field(x), lambda f: told(head, x, f)))

    heads = T.captures(F.concat(F.lit("\n"), text), rf"(?=((?s:.)(?=(?-i:[{_FIRST}]))(?:{_ANY_LABEL}|{V.FEE_LABEL})(?s:.*)))")
    return F.transform(heads, of)


def label_values(heads: Column) -> list[tuple[str, int, Column]]:
    """(field, position, value) of ``label: value``: of each label the first that has a value."""
    first = lambda i: F.get(F.filter(heads, lambda h: (h["label"] == i) & h["pair"].isNotNull()), F.lit(0))["pair"]
    return [(field, i, first(i)) for i, (_, field) in enumerate(_LABELS)]


def glued_value(heads: Column, field: str) -> Column:
    """Value of a form row read as one line: of the field's labels the first that has one."""
    return F.get(F.filter(heads, lambda h: (h["field"] == field) & h["glued"].isNotNull()), F.lit(0))["glued"]


def correction(text: Column) -> tuple[Column, Column]:
    """Field and value of a manual correction."""
    return T.lookup(T.fold(T.capture(text, P.CORRECTION)), V.CORRECTED), T.collapse(T.capture(text, P.CORRECTION, 2))


def attested_sponsor(text: Column) -> Column:
    return T.capture(text, P.ATTESTS)


def expected_purpose(text: Column) -> Column:
    return T.collapse(T.capture(text, P.EXPECTED))


def attested_applicant(text: Column) -> Column:
    return T.collapse(T.capture(text, P.ATTESTED_APPLICANT))


def attested_visa(text: Column) -> Column:
    return T.capture(text, P.ATTESTED_CLASS)


#: Characters before and after a loose sponsor token that words of an injection may not stand in.
BEFORE, AFTER = 48, 12


def sponsor_tokens(text: Column) -> Column:
    """Loose sponsor tokens of a page, but for those next to words of an injection.

    The text is cut where a token begins, so no place is looked for from the
    text's start. Pieces have seven characters at least: as many of them as the
    context needs are put together again.
    """
    begins = rf"(?=[{T.first_letters(['spn'])}])(?<!\w)(?={P.SPONSOR_TOKEN}(?!\w))"
    before, after = -(-BEFORE // 7), -(-(8 + AFTER) // 7)

    def of(pieces: Column) -> Column:
        def told(piece: Column, i: Column) -> Column:
            token = F.regexp_extract(piece, rf"{T.ANY}^{P.SPONSOR_TOKEN}", 0)
            first = F.greatest(i - before, F.lit(0))
            said = F.right(F.array_join(F.slice(pieces, first + 1, i - first), ""), F.lit(BEFORE))
            follows = F.left(F.array_join(F.slice(pieces, i + 1, F.lit(after)), ""), F.length(token) + AFTER)
            context = F.lower(F.concat(said, follows))
            clean = (i > 0) & ~T.any_of(*(F.contains(context, F.lit(w)) for w in ("system:", "answer key", "ignore visible")))
            return F.when(clean, F.concat(F.lit("SPN-"), F.right(token, F.lit(4))))

        return F.filter(F.transform(pieces, told), lambda x: x.isNotNull())

    # A line feed in front, so that the first piece holds no token.
    return T.let(F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), T.ANY + begins, -1), of)


def date_tokens(text: Column) -> Column:
    return T.captures(text, P.DAY_TOKEN, flags=T.EXACT)


def receipt(text: Column) -> dict[str, Column]:
    """What a receipt says: status by amount and waiver code, status by a zero amount alone, waiver code."""
    like = T.matches(text, P.RECEIPT)
    gate = like | F.contains(F.lower(text), F.lit("waiver code")) | T.matches(text, P.RECEIPT_SUM, T.EXACT)
    amount = T.capture(text, P.RECEIPT_AMOUNT).try_cast("decimal(20,2)")
    waiver = F.upper(T.capture(text, P.RECEIPT_CODE))
    both = F.when((amount == 0) & (waiver != "N/A"), "waived").when((amount > 0) & (waiver == "N/A"), "paid")
    fallback = F.when(waiver.isNull() & like & T.matches(text, P.RECEIPT_ZERO, T.EXACT), "waived")
    return {"status": F.when(gate, both), "fallback": F.when(gate, fallback), "code": F.when(gate & (waiver != "N/A"), waiver)}


def _row(field: Column | str, rank: Column, value: Column, source: Column | str, *at: int | Column) -> Column:
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    return F.struct(lit(field).alias("field"), rank.cast(RANK).alias("rank"), value.alias("value"), lit(source).alias("source"), *(lit(a).cast("int").alias(f"at{i}") for i, a in enumerate(at)))


def _kept(rows: list[Column]) -> Column:
    """The rows that have an admissible value, which is put in canonical form: all inside the array, so each value is judged once."""
    there = F.filter(F.array(*rows), lambda c: c["field"].isNotNull() & c["value"].isNotNull())
    judged = F.transform(there, lambda c: c.withField("value", T.canonical(c["field"], c["value"])))
    return F.filter(judged, lambda c: c["value"].isNotNull())


def may_tell(text: Column) -> Column:
    """Whether a span can give a candidate at all: it holds a label or is one, or words of a correction or an attestation."""
    return T.matches(text, f"{_ANY_LABEL}|{V.FEE_LABEL}|{P.TELLING}") | label_of(text).isNotNull()


def span_candidates(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Candidates that single spans give."""
    keys = ["case_id", "page"]
    text = F.col("text")
    known = spans.where(may_tell(text)).select(*keys, "ord", "text", "source").join(pages.select(*keys, F.col("rank").alias("page_rank"), F.col("ocr_only").cast("int").alias("late")), keys)
    ocr = F.startswith("source", F.lit("ocr:"))
    rank = F.col("page_rank").cast(RANK) + F.when(ocr, _dec(V.OCR_OFFSET)).otherwise(_dec("0"))
    cells = right_cells(spans, label_of(text).isNotNull() & ~is_correction(text)).withColumnRenamed("value", "cell")
    known = known.join(cells, [*keys, "ord"], "left").withColumns({"rank": rank, "plain": ~is_correction(text)})
    plain, heads = F.col("plain"), F.col("heads")
    known = known.withColumn("heads", F.when(plain & has_label(text), label_heads(text)))
    fields = list(V.LABELS)
    cell = F.when(~F.contains(T.fold(F.col("cell")), F.lit("sample denial")), F.col("cell"))
    named, corrected = correction(text)
    rows = [_row(label_of(text), F.col("rank"), F.when(plain, cell), F.col("source"), 1, 0)]
    rows += [_row(f, F.col("rank"), v, F.col("source"), 2, i) for f, i, v in label_values(heads)]
    rows += [_row(f, F.col("rank"), glued_value(heads, f), F.col("source"), 3, i) for i, f in enumerate(fields)]
    rows += [
        _row(named, _dec(V.CORRECTION_RANK), corrected, "manual_correction", 4, 0),
        _row("sponsor_id", F.col("rank"), attested_sponsor(text), "sponsor_attestation", 5, 0),
        _row("declared_purpose", F.col("rank"), expected_purpose(text), "sponsor_attestation", 6, 0),
    ]
    return known.select(*keys, "late", "ord", F.explode(_kept(rows)).alias("c")).select(*keys, "late", "ord", "c.*")


def page_candidates(pages: DataFrame) -> DataFrame:
    """Candidates that whole pages give."""
    text = F.col("text")
    rank = F.col("rank").cast(RANK) + F.when(F.col("ocr_only"), _dec(V.OCR_OFFSET)).otherwise(_dec("0"))
    off = lambda v: rank + _dec(v)
    dates = date_tokens(text)
    paper = receipt(text)
    rows = [
        _row("sponsor_id", off(V.ATTEST_OFFSET), attested_sponsor(text), "sponsor_attestation", 7, 0),
        _row("declared_purpose", off(V.ATTEST_OFFSET), expected_purpose(text), "sponsor_attestation", 8, 0),
        _row("applicant_name", off(V.ATTEST_OFFSET), attested_applicant(text), "sponsor_attestation", 9, 0),
        _row("visa_class", off(V.ATTEST_OFFSET), attested_visa(text), "sponsor_attestation", 10, 0),
        _row("sponsor_id", off(V.SPONSOR_TOKEN_OFFSET), T.only(sponsor_tokens(text)), "sponsor_token", 11, 0),
        _row("arrival_date", off(V.DATE_TOKEN_OFFSET), F.when(F.size(dates) == 1, F.get(dates, F.lit(0))), "date_token", 12, 0),
        _row("fee_status", off(V.RECEIPT_OFFSET), paper["status"], "receipt_amount_waiver", 13, 0),
        _row("waiver_code", off(V.RECEIPT_OFFSET), paper["code"], "receipt_waiver_code", 14, 0),
        _row("fee_status", off(V.RECEIPT_FALLBACK_OFFSET), paper["fallback"], "receipt_amount_fallback", 15, 0),
    ]
    late = F.col("ocr_only").cast("int").alias("late")
    return pages.select("case_id", "page", late, F.lit(LAST).alias("ord"), F.explode(_kept(rows)).alias("c")).select("case_id", "page", "late", "ord", "c.*")


def candidates(spans: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """All candidates of ``spans``, admissible values only, in canonical form. ``pages`` are their ``page_texts``, if they are at hand.

    Pages of the text layer come before those that only OCR has.
    """
    pages = settle(page_texts(spans)) if pages is None else pages
    found = span_candidates(spans, pages).unionByName(page_candidates(pages))
    return found.select("case_id", "field", "rank", "value", "source", F.struct("late", "page", "ord", "at0", "at1").alias("at"))


def case_flags(pages: DataFrame) -> DataFrame:
    """(case_id, flags): risk flags that any page shows."""
    return pages.groupBy("case_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.page_flags(F.col("text")))))).alias("flags"))


def manual_findings(pages: DataFrame) -> DataFrame:
    """(case_id, manual): finding of the last page that has one, on adjudicator pages."""
    text = F.col("text")
    found = F.when((F.col("rank") == 1) | T.matches(text, P.FINDING_PAGE), T.finding(text))
    late = F.struct(F.col("ocr_only").cast("int"), F.col("page"))
    return pages.withColumn("found", found).where("found is not null").groupBy("case_id").agg(F.max_by("found", late).alias("manual"))

