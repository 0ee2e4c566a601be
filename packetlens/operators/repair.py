"""Layout repairs: weak or unknown fields from what the page layout proves.

Each repair is a projection over the wide packet relation and the ``proof``
text. Repairs touch different fields, so they all read the state before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import patterns as P
from packetlens.functions import text as T
from packetlens.functions import vocab as V

from .resolve import RESOLVED, UNKNOWN, normalize_record
from .stage import sealed


def unknown_scalar(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("", "unknown", "n/a", "none", "1900-01-01")


def weak_source(source: Column) -> Column:
    return source.isNull() | source.isin("rapidocr", "forensic_ocr", "layout_text") | F.coalesce(F.startswith(source, F.lit("ocr")), F.lit(False))


def with_page_proof(packets: DataFrame) -> DataFrame:
    """Adds ``page_proof``, the injection-free text of layout and pages, unless it is there already."""
    if "page_proof" in packets.columns:
        return packets
    return sealed(packets.withColumn("page_proof", _lines(F.col("layout_text"), T.strip_injection(F.col("page_text")))))


def with_proof(packets: DataFrame) -> DataFrame:
    """Adds ``proof``, the injection-free text of layout, pages and OCR, unless it is there already."""
    if "proof" in packets.columns:
        return packets
    return sealed(with_page_proof(packets).withColumn("proof", _lines(F.col("page_proof"), T.strip_injection(F.col("all_text")))))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def _open(field: str) -> Column:
    return F.col(f"{field}_state") == UNKNOWN


# A value that an expression needs several times is bound by ``T.let``: nothing else keeps it from being computed again in each place.


def fee_pick(text: Column) -> Column:
    fill = _open("fee_status") | (F.lower("fee_status") == "unknown")
    # A proven fee is what the layout says, too.
    return F.when(fill, T.layout_fee(text)).when((F.lower("fee_status") == "unpaid") & T.fee_proven(text), "paid")


def name_pick(text: Column) -> Column:
    now = F.trim("applicant_name")

    def of(found: Column) -> Column:
        registry, applicant = found["registry"], found["applicant"]
        pick = F.coalesce(registry, applicant)
        replace = (now != pick) & (_open("applicant_name") | weak_source(F.col("applicant_name_source")) | F.coalesce(registry == applicant, F.lit(False)))
        return F.when(unknown_scalar(now) | replace, pick)

    return T.let(F.struct(T.only(T.registry_names(text)).alias("registry"), T.only(T.applicant_names(text)).alias("applicant")), of)


def _fill(field: str, found: Column) -> Column:
    return F.when(_open(field) | unknown_scalar(F.col(field)), T.only(found))


def visa_pick(text: Column) -> Column:
    return _fill("visa_class", T.layout_visas(text))


def arrival_pick(text: Column) -> Column:
    return _fill("arrival_date", T.layout_arrivals(text))


def world_pick(text: Column) -> Column:
    return _fill("home_world", T.layout_worlds(text))


def species_pick(text: Column) -> Column:
    return _fill("species_code", T.layout_species(text))


def sponsor_pick(text: Column) -> Column:
    now = F.col("sponsor_id")
    blank = now.isin("SPN-0000", "unknown", "")

    def of(found: Column) -> Column:
        revoked, attested = found["revoked"], found["attested"]
        near = now.rlike(r"^SPN-\d{4}$") & (F.left(now, F.lit(7)) == F.left(attested, F.lit(7))) & (now != attested)
        pick = F.coalesce(revoked, F.when(blank | near, attested))
        return F.when(_open("sponsor_id") | blank | (weak_source(F.col("sponsor_id_source")) & (now != pick)), pick)

    return T.let(F.struct(T.only(T.captures(text, P.REVOKED_ID)).alias("revoked"), T.only(T.captures(text, P.ATTESTS_ID)).alias("attested")), of)


def purpose_pick(text: Column) -> Column:
    now = F.lower("declared_purpose")
    default = V.PURPOSES[0]
    bound = T.only(T.bound_purposes(text, now))

    def of(attested: Column) -> Column:
        override = attested.isNotNull() & (_open("declared_purpose") | (now == "unknown") | ((now == default) & (attested != now)))
        return F.when(override, attested).when(_open("declared_purpose") | now.isin("unknown", default), bound)

    return T.let(T.attested_purpose(text), of)


PICKS = {
    "fee_status": fee_pick,
    "applicant_name": name_pick,
    "visa_class": visa_pick,
    "arrival_date": arrival_pick,
    "home_world": world_pick,
    "species_code": species_pick,
    "sponsor_id": sponsor_pick,
    "declared_purpose": purpose_pick,
}


def repair_field(packets: DataFrame, field: str, proof: str = "proof") -> DataFrame:
    """One field's repair; adds ``<field>_repaired``."""
    pick = PICKS[field](F.col(proof))
    df = packets.withColumn("_pick", F.when(F.coalesce(F.col(proof), F.lit("")) != "", pick))
    hit = F.col("_pick").isNotNull()
    return df.withColumns(
        {
            field: F.coalesce("_pick", field),
            f"{field}_state": F.when(hit, RESOLVED).otherwise(F.col(f"{field}_state")),
            f"{field}_source": F.when(hit, "layout_text").otherwise(F.col(f"{field}_source")),
            f"{field}_repaired": hit,
        }
    ).drop("_pick")


def repair(packets: DataFrame) -> DataFrame:
    """All repairs on the proof of layout, page and OCR texts, then ``normalize_record``. The proofs stay, for the gates."""
    df = with_proof(packets)
    for field in PICKS:
        df = repair_field(df, field)
    df = sealed(df)
    return normalize_record(df.drop(*(f"{f}_repaired" for f in PICKS)))
