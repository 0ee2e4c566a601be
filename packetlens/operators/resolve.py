"""Conflict resolution: candidates to values, values to typed evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.functions import vocab as V

RESOLVED, UNKNOWN, CONTESTED = "resolved", "unknown", "contested"
PREFIX_FIELDS = ("species_code", "home_world", "visa_class", "declared_purpose")
CONFLICTS = {"applicant_name": "identity_conflict", "sponsor_id": "sponsor_mismatch"}


def near_duplicates(values: Column) -> Column:
    """Whether all pairs of distinct strings differ by two edits at most."""

    def close(a: Column, b: Column) -> Column:
        long_enough = (F.length(a) >= 2) & (F.length(b) >= 2)
        return (a >= b) | ((F.abs(F.length(a) - F.length(b)) <= 2) & long_enough & (F.levenshtein(a, b, 2) >= 0))

    return F.forall(values, lambda a: F.forall(values, lambda b: close(a, b)))


def pick_fields(candidates: DataFrame) -> DataFrame:
    """(case_id, field, value, source, conflict, best_rank): what stands for each field.

    The best rank's only value wins, the first by order. Several values there
    are settled by a single trusted one, by near-equal names, or by a value that
    begins all others; else the field stays open. Names and sponsors that trusted sources
    contradict are conflicts. One grouping on (case_id, field); a group is a packet's few candidates.
    """
    row = F.struct("rank", "at", "value", "source", T.fold(F.col("value")).alias("norm"))
    grouped = candidates.groupBy("case_id", "field").agg(F.array_sort(F.collect_list(row)).alias("all"))
    best = F.filter("all", lambda c: c["rank"] == F.get("all", F.lit(0))["rank"])
    grouped = grouped.withColumn("best", best)
    norms = lambda rows: F.array_distinct(F.transform(rows, lambda c: c["norm"]))
    text_layer = lambda rows: F.filter(rows, lambda c: c["source"] == "text_layer")
    first = lambda rows: F.get(rows, F.lit(0))
    kinds = norms(F.col("best"))
    trusted = text_layer(F.col("best"))
    longest = F.array_max(F.transform("best", lambda c: F.struct(F.length(c["value"]).alias("n"), c["value"].alias("value"))))["value"]
    shortest = F.array_min(F.transform(kinds, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))["v"]
    begins = (F.length(shortest) >= 3) & F.forall(kinds, lambda v: (v == shortest) | F.startswith(v, F.concat(shortest, F.lit(" "))))
    many = F.size(kinds) > 1
    chosen = (
        F.when(~many, first(F.col("best")))
        .when(F.size(norms(trusted)) == 1, first(trusted))
        .when((F.col("field") == "applicant_name") & near_duplicates(kinds), first(F.filter("best", lambda c: c["value"] == longest)))
        .when(F.col("field").isin(*PREFIX_FIELDS) & begins, first(F.filter("best", lambda c: c["norm"] == shortest)))
    )
    corrected = F.exists("all", lambda c: c["source"] == "manual_correction")
    disputed = F.when(many, F.col("chosen").isNull()).otherwise(~corrected & (F.size(norms(text_layer(F.col("all")))) > 1))
    conflict = F.when(disputed, T.lookup(F.col("field"), CONFLICTS))
    return grouped.withColumn("chosen", chosen).select(
        "case_id", "field", F.col("chosen")["value"].alias("value"), F.col("chosen")["source"].alias("source"), conflict.alias("conflict"), first(F.col("best"))["rank"].alias("best_rank")
    )


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The candidates of each field's best rank."""
    low = candidates.groupBy("case_id", "field").agg(F.min("rank").alias("rank"))
    return candidates.join(low, ["case_id", "field", "rank"], "left_semi")


def normalize_record(df: DataFrame) -> DataFrame:
    """Scalars in their final shape: upper-case classes, valid ids and days, one fee word; sentinels elsewhere."""
    sponsor = F.upper("sponsor_id")
    words = T.fold(F.col("fee_status"))
    fee = F.coalesce(*(F.when(T.matches(words, rf"\b{w}\b", T.EXACT), w) for w in ("unpaid", "waived", "paid", "unknown")), F.lit("unknown"))
    return df.withColumns(
        {
            "visa_class": F.upper(F.coalesce("visa_class", F.lit("unknown"))),
            "sponsor_id": F.when(sponsor.rlike(r"^SPN-\d{4}$"), sponsor).otherwise(V.BLANK["sponsor_id"]),
            "arrival_date": F.when(T.is_iso_date(F.col("arrival_date")), F.col("arrival_date")).otherwise(V.BLANK["arrival_date"]),
            "fee_status": fee,
        }
    )


def scalar_state(field: str, value: Column, source: Column) -> Column:
    """Whether a filled value is evidence: a default without a source never is."""
    folded = F.lower(F.coalesce(value, F.lit("")))
    if field == "fee_status":
        open_ = folded.isin("", "unknown")
    elif field == "visa_class":
        open_ = F.upper(F.trim(folded)).isin("", "UNKNOWN")
    elif field in ("sponsor_id", "arrival_date"):
        open_ = folded.isin("", V.BLANK[field].lower()) & source.isNull()
    else:
        open_ = (value.isNull() | (folded == "unknown")) & source.isNull()
    return F.when(open_, UNKNOWN).otherwise(RESOLVED)


def risk_evidence(flags: Column, cleared: Column, source: Column) -> tuple[Column, Column, Column]:
    """(state, value, source) of the risk: flags, else clearance, else unknown."""
    some = F.size(flags) > 0
    state = F.when(some | cleared, RESOLVED).otherwise(UNKNOWN)
    value = F.when(some, T.encode_flags(flags)).when(cleared, "none")
    return state, value, F.when(some | cleared, F.coalesce(source, F.lit("text_layer"))).otherwise(source)


def with_scalar_evidence(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{f}_state": scalar_state(f, F.col(f), F.col(f"{f}_source")) for f in V.SCALARS})


def resolve(spans: DataFrame, pages: DataFrame, found: DataFrame, page_info: DataFrame) -> DataFrame:
    """The wide packet relation from spans.

    ``pages``: case_id, page, text of the text layer without injections, one row a page;
    ``found``: candidates; ``page_info``: page texts of the spans with rank. Columns:
    case_id, the scalars with ``_state`` and ``_source``, flags, risk_state,
    risk_value, risk_source, manual, manual_source, page_text, all_text.
    """
    from .candidates import case_flags, manual_findings
    from .spans import case_texts, joined

    picked = pick_fields(found)
    first = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = picked.groupBy("case_id").agg(
        *(first(f, "value").alias(f) for f in V.SCALARS),
        *(first(f, "source").alias(f"{f}_source") for f in V.SCALARS),
        F.array_sort(F.collect_set("conflict")).alias("conflicts"),
    )
    layer = pages.groupBy("case_id").agg(joined(["page"], separator="\n").alias("page_text"))
    texts = case_texts(spans).withColumnRenamed("text", "all_text")
    any_ocr = spans.groupBy("case_id").agg(F.bool_or(F.startswith("source", F.lit("ocr"))).alias("any_ocr"))
    cases = layer.join(texts, "case_id", "full").join(any_ocr, "case_id", "left").join(wide, "case_id", "left")
    cases = cases.join(case_flags(page_info), "case_id", "left").join(manual_findings(page_info), "case_id", "left")
    cases = cases.fillna({"page_text": "", "all_text": "", "any_ocr": False, **{f: V.BLANK[f] for f in V.SCALARS}})
    empty = F.array().cast("array<string>")
    cases = cases.withColumn("flags", F.array_sort(F.array_union(F.coalesce("flags", empty), F.coalesce("conflicts", empty))))
    cases = with_scalar_evidence(normalize_record(cases))
    by_text, by_all = T.cleared(F.col("page_text")), T.cleared(F.col("all_text"))
    some = F.size("flags") > 0
    source = F.when(some & F.col("any_ocr") & ~by_text, "ocr").when(some | by_text, "text_layer").when(by_all, "ocr")
    state, value, source = risk_evidence(F.col("flags"), by_text | by_all, source)
    said = F.concat(F.lit(r"(?iUd)\bfinding\s*:\s*"), F.col("manual"), F.lit(r"\b"))
    manual_source = F.when(F.col("manual").isNotNull(), F.when(F.regexp_like("page_text", said), "text_layer").otherwise("ocr"))
    cases = cases.withColumns({"risk_state": state, "risk_value": value, "risk_source": source, "manual_source": manual_source})
    return cases.withColumn("risk_flags", F.coalesce("risk_value", F.lit("none"))).drop("conflicts", "any_ocr")
