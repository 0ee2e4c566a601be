"""Registered queries of the packet engine: each applies an operator to a fixture relation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.functions import vocab as V
from packetlens.operators import analysis, decide, driver, fill, ocr, repair, resolve, spans
from packetlens.operators import candidates as C

from . import folder, pipeline
from .fixtures import STALE, fixture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def on(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a function of one fixture."""

    def register(run: Callable[[DataFrame], DataFrame]) -> Query:
        def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(fixture(spark, sf_dir, name))

        QUERIES[run.__name__] = whole
        return whole

    return register


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide packets with flags as an array and the layout text without injections."""
    df = fixture(spark, sf_dir, "wide")
    return df.withColumns({"flags": T.decode_flags(F.col("risk_flags")), "layout_text": T.strip_injection(F.col("layout_raw"))})


#: Orders that share a case id stand in the order of their keys wherever their spans tie.
_SHARED = ("k",)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.page_texts(fixture(spark, sf_dir, "spans"), tie=_SHARED)


# Policy and records


@on("packets")
def adjudicate_packets(packets: DataFrame) -> DataFrame:
    decided = decide.adjudicate(resolve.normalize_record(packets), STALE)
    return decided.select("case_id", "applicant_name", "home_world", "visa_class", "sponsor_id", "arrival_date", "fee_status", "risk_flags", "reason", "adjudication", "confidence")


@on("packets")
def policy_reason_counts(packets: DataFrame) -> DataFrame:
    return resolve.normalize_record(packets).groupBy(decide.policy_reason(stale_before=STALE).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@on("dirty")
def normalize_records(dirty: DataFrame) -> DataFrame:
    raw = dirty.select("case_id", F.col("visa").alias("visa_class"), F.col("sponsor").alias("sponsor_id"), F.substring("day", 1, 10).alias("arrival_date"), F.col("fee").alias("fee_status"))
    return resolve.normalize_record(raw)


@query
def blank_record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("case_id"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("case_id")).agg(F.max("o_orderstatus").alias("fee_status"))
    rest = {f: F.lit(None).cast("double" if f == "confidence" else "string") for f in V.BLANK if f != "fee_status"}
    return driver.with_defaults(customers, orders.withColumns(rest))


# Spans, pages, lines

_PLACE = ("case_id", "page", "ord", "text")


@on("spans")
def visible_spans(rows: DataFrame) -> DataFrame:
    return spans.visible(rows).select(*_PLACE)


@query
def inside_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.inside(fixture(spark, sf_dir, "spans"), fixture(spark, sf_dir, "pages_dim")).select(*_PLACE)


@on("spans")
def decoy_spans(rows: DataFrame) -> DataFrame:
    return rows.where(T.decoy_span(F.col("text"))).select(*_PLACE)


@on("line_pages")
def trusted_lines(pages: DataFrame) -> DataFrame:
    return pages.select("conv_id", "turn", T.kept_lines(F.col("text")).alias("text"))


@on("line_pages")
def strip_injection(pages: DataFrame) -> DataFrame:
    return pages.select("conv_id", "turn", T.strip_injection(F.col("text")).alias("text"))


@query
def footer_only_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.footer_pages(page_texts(spark, sf_dir))


@on("spans")
def meaningful_pages(rows: DataFrame) -> DataFrame:
    return spans.meaningful_pages(rows)


def _todo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages, images = spans.page_layout(fixture(spark, sf_dir, "spans")), fixture(spark, sf_dir, "images")
    return pages, images, spans.pages_to_ocr(pages, None, images)


@query
def pages_to_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _todo(spark, sf_dir)[2]


@query
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, images, todo = _todo(spark, sf_dir)
    needs = fixture(spark, sf_dir, "wide").select("case_id", (F.col("risk_state") == "unknown").alias("need_risk"))
    return spans.audit_pages(pages, images, todo, needs)


@query
def oracle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.oracle_pages(page_texts(spark, sf_dir), fixture(spark, sf_dir, "images"))


@query
def page_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _, todo = _todo(spark, sf_dir)
    keys = ["case_id", "page"]
    covered = pages.select(keys).exceptAll(todo)
    both = todo.withColumn("todo", F.lit(True)).unionByName(covered.withColumn("todo", F.lit(False)))
    return both.groupBy("case_id").agg(F.count_if("todo").alias("todo"), F.count_if(~F.col("todo")).alias("covered"))


@on("spans")
def case_texts(rows: DataFrame) -> DataFrame:
    return spans.case_texts(rows, tie=_SHARED)


# OCR

_TIE = ("t1", "t2", "t3")


@on("words")
def ocr_words_to_lines(words: DataFrame) -> DataFrame:
    return ocr.words_to_lines(words, tie=_TIE).withColumn("confidence", F.round("confidence", 6))


@on("words")
def page_mean_confidence(words: DataFrame) -> DataFrame:
    return ocr.mean_confidence(ocr.words_to_lines(words, tie=_TIE), ["case_id", "page_num"]).withColumn("confidence", F.round("confidence", 6))


@on("spans")
def contrast_retry(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("confidence", (F.col("k") % 10).cast("double") / 10)
    original = rows.where((F.col("source") != "ocr:original") | (F.col("ord") < 3))
    return ocr.contrast_lines(original, rows.where("source = 'ocr:original'")).select(*_PLACE)


@on("spans")
def fee_crop_pages(rows: DataFrame) -> DataFrame:
    return ocr.fee_crop_pages(rows)


@on("words")
def distinct_ocr_texts(words: DataFrame) -> DataFrame:
    reads = words.groupBy("case_id", "page_num", "text").agg(F.min("t1").alias("crop"))
    return ocr.distinct_texts(reads, ["case_id", "page_num"])


# Candidates


@on("spans")
def same_line_value(rows: DataFrame) -> DataFrame:
    return spans.right_cells(rows, C.label_of(F.col("text")).isNotNull())


def _exploded(rows: DataFrame, pairs: list[tuple[str, Column]]) -> DataFrame:
    values = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs))
    plain = rows.where(C.has_label(F.col("text")) & ~C.is_correction(F.col("text")))
    return plain.select("case_id", "page", "ord", F.explode(values).alias("c")).select("case_id", "page", "ord", "c.*").where("value is not null")


@on("spans")
def label_value_pairs(rows: DataFrame) -> DataFrame:
    headed = rows.where(F.contains("text", F.lit(":"))).withColumn("heads", C.label_heads(F.col("text")))
    return _exploded(headed, [(f, v) for f, _, v in C.label_values(F.col("heads"))])


@on("spans")
def glued_rows(rows: DataFrame) -> DataFrame:
    headed = rows.withColumn("heads", C.label_heads(F.col("text")))
    return _exploded(headed, [(f, C.glued_value(F.col("heads"), f)) for f in V.LABELS])


@on("spans")
def manual_corrections(rows: DataFrame) -> DataFrame:
    field, value = C.correction(F.col("text"))
    return rows.select("case_id", "page", "ord", field.alias("field"), value.alias("value")).where("field is not null")


@query
def attestation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return page_texts(spark, sf_dir).select(
        "case_id",
        "page",
        C.attested_sponsor(text).alias("sponsor_id"),
        C.expected_purpose(text).alias("declared_purpose"),
        C.attested_applicant(text).alias("applicant_name"),
        C.attested_visa(text).alias("visa_class"),
    )


@query
def token_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    dates = C.date_tokens(text)
    pages = page_texts(spark, sf_dir)
    return pages.select("case_id", "page", T.only(C.sponsor_tokens(text)).alias("sponsor_id"), F.when(F.size(dates) == 1, F.get(dates, F.lit(0))).alias("arrival_date"))


@query
def receipt_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(spark, sf_dir).select("case_id", "page", *(v.alias(k) for k, v in C.receipt(F.col("text")).items()))


@on("dirty")
def page_flags(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", T.encode_flags(T.page_flags(F.col("risk"))).alias("flags"), T.cleared(F.col("risk")).alias("cleared"))


@on("dirty")
def manual_findings(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", T.finding(F.col("note")).alias("finding"))


@query
def source_rank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(spark, sf_dir).select("case_id", "page", "rank")


@query
def all_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.candidates(fixture(spark, sf_dir, "spans"))
    return found.select("case_id", "field", F.col("rank").cast("double").alias("rank"), "value", "source", F.col("at")["page"].alias("page"), F.col("at")["ord"].alias("ord"), F.col("at")["at0"].alias("step"))


# Canonical values


@on("dirty")
def canon_fee(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", F.col("fee").alias("raw"), T.fee(F.col("fee")).alias("fee"))


@on("dirty")
def canon_name(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", F.col("name").alias("raw"), T.name(F.col("name")).alias("name"))


@on("dirty")
def canon_visa(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", F.col("visa").alias("raw"), T.visa(F.col("visa")).alias("visa"))


@on("dirty")
def canon_date(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", F.col("day").alias("raw"), T.date(F.col("day")).alias("day"))


@on("dirty")
def recover_flags(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", T.encode_flags(T.flags(F.col("risk"))).alias("flags"))


@on("dirty")
def layout_flags(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", T.encode_flags(T.layout_flags(F.col("risk"))).alias("flags"))


@on("packets")
def encode_flags(packets: DataFrame) -> DataFrame:
    return packets.groupBy("c").agg(T.encode_flags(F.flatten(F.collect_set(T.decode_flags(F.col("risk_flags"))))).alias("flags"))


# Resolution


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.struct("a1", "a2", "a3", "a4", "a5", "a6"))


@on("candidates")
def best_rank_candidates(rows: DataFrame) -> DataFrame:
    return resolve.best_candidates(rows).select("case_id", "field", "value", "source", F.col("rank").cast("double").alias("rank"))


@on("candidates")
def pick_fields(rows: DataFrame) -> DataFrame:
    return resolve.pick_fields(_ordered(rows)).withColumn("best_rank", F.col("best_rank").cast("double"))


@on("candidates")
def field_conflicts(rows: DataFrame) -> DataFrame:
    return resolve.pick_fields(_ordered(rows)).where("conflict is not null").groupBy("conflict").agg(F.count(F.lit(1)).alias("n"))


@on("candidates")
def near_duplicate_names(rows: DataFrame) -> DataFrame:
    best = resolve.best_candidates(rows).groupBy("case_id", "field").agg(F.collect_set(T.fold(F.col("value"))).alias("norms"))
    return best.select("case_id", "field", resolve.near_duplicates(F.col("norms")).alias("near"))


@on("wide")
def scalar_evidence(rows: DataFrame) -> DataFrame:
    state = lambda f: resolve.scalar_state(f, F.col(f), F.nullif(F.col(f"{f}_source"), F.lit("ocr"))).alias(f)
    return rows.select("case_id", *(state(f) for f in ("fee_status", "visa_class", "sponsor_id", "arrival_date", "home_world")))


@query
def risk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, value, source = resolve.risk_evidence(F.col("flags"), T.cleared(F.col("page_text")), F.col("risk_source"))
    return wide(spark, sf_dir).select("case_id", state.alias("state"), value.alias("value"), source.alias("source"))


# Gap filling


@on("ocr_texts")
def rapid_parse(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    rapid = rows.where("stage = 'rapid'")
    return rapid.select("case_id", T.rapid_fee(text).alias("fee_status"), T.rapid_visa(text).alias("visa_class"), T.encode_flags(T.flags(text)).alias("risk_flags"), T.cleared(text).alias("cleared"))


_FILLED = ("case_id", "fee_status", "fee_status_source", "visa_class", "visa_class_source", "risk_state", "risk_value", "risk_source", "risk_flags")


@query
def gap_fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixture(spark, sf_dir, "ocr_texts")
    return fill.fill_unknown(wide(spark, sf_dir), fill.stored_reader(texts, "rapid")).select(*_FILLED)


@query
def fee_boost_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixture(spark, sf_dir, "ocr_texts")
    return fill.boost_fee(wide(spark, sf_dir), fill.stored_reader(texts, "boost")).select("case_id", "fee_status", "fee_status_state", "fee_status_source")


@query
def forensic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = fixture(spark, sf_dir, "ocr_texts")
    return fill.forensic_risk(wide(spark, sf_dir), fill.stored_reader(texts, "forensic")).select("case_id", "risk_state", "risk_value", "risk_source", "risk_flags")


# Repairs


def _repair(field: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        repaired = repair.repair_field(repair.with_proof(wide(spark, sf_dir)), field)
        return repaired.select("case_id", field, F.col(f"{field}_source").alias("source"), F.col(f"{field}_repaired").alias("repaired"))

    return run


for _field in repair.PICKS:
    QUERIES[f"repair_{_field}"] = _repair(_field)


# Decisions


@query
def decide_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decide(wide(spark, sf_dir), STALE).select("case_id", "adjudication", "confidence", "reason")


@query
def clean_packet_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.clean_gate(decide.decide(wide(spark, sf_dir), STALE), STALE).select("case_id", "adjudication", "confidence", "gate", "risk_source")


@query
def consensus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.consensus_gate(decide.decide(wide(spark, sf_dir), STALE), STALE).select("case_id", "adjudication", "confidence", "gate")


@query
def pipeline_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide packets through repairs, decision, gates and output."""
    return decide.emit(decide.gates(decide.decide(repair.repair(wide(spark, sf_dir)), STALE), STALE))


@query
def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans through candidates, resolution, gap filling, repairs, decision, gates and output."""
    rows, texts = fixture(spark, sf_dir, "spans"), fixture(spark, sf_dir, "ocr_texts")
    evidence = spans.trusted(rows, fixture(spark, sf_dir, "pages_dim").withColumns({"width": F.lit(320.0), "height": F.lit(400.0)}))
    pages = rows.where(~F.startswith("source", F.lit("ocr"))).groupBy("case_id", "page").agg(spans.joined(["ord"], separator="\n").alias("text"))
    readers = tuple(fill.stored_reader(texts, stage) for stage in ("rapid", "boost", "forensic"))
    return decide.emit(pipeline.run(evidence, pages, readers, STALE))


# Driver and analysis


@query
def folder_to_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet of a folder gets a record: those that could be read theirs, the others the blank one."""
    cases = fixture(spark, sf_dir, "wide").select("case_id")
    unreadable = cases.where(F.substring("case_id", -1, 1) == "7")
    return folder.records_of(cases, pipeline_layout(spark, sf_dir).join(unreadable, "case_id", "left_anti"))


@query
def emit_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = pipeline_layout(spark, sf_dir)
    return records.select("case_id", driver.json_line(records.columns).alias("line"))


@on("packets")
def packet_slice(packets: DataFrame) -> DataFrame:
    return driver.take_slice(packets.select("case_id", "visa_class"), 100, 500)


@query
def case_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = fixture(spark, sf_dir, "packets")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    # By the order's key: from a million on, orders share the six digits of a case_id.
    listed = orders.select(F.col("o_orderkey").alias("k"), (F.lit(1_000_000_000_000) - F.col("o_orderkey")).cast("long").alias("pos"))
    return driver.by_case_list(packets.select("k", "case_id", "visa_class", "fee_status"), listed, "k").select("pos", "case_id", "visa_class", "fee_status")


@query
def pure_miss_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.pure_misses(fixture(spark, sf_dir, "truth"), fixture(spark, sf_dir, "predictions"))


@query
def first_miss_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.first_misses(fixture(spark, sf_dir, "truth"), fixture(spark, sf_dir, "predictions"), 40)


@query
def risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(spark, sf_dir).select("case_id", "page", *(v.alias(k) for k, v in T.signals(F.col("text")).items()))


@query
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.signal_summary(page_texts(spark, sf_dir))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.confusion(fixture(spark, sf_dir, "truth"), fixture(spark, sf_dir, "predictions"))


@query
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.calibration(fixture(spark, sf_dir, "truth"), fixture(spark, sf_dir, "predictions"))


@query
def training_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.training_cohort(fixture(spark, sf_dir, "truth"), fixture(spark, sf_dir, "rasters"), ["width", "height", "n"]).select("case_id", "n", "label")


@query
def alt_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_texts(spark, sf_dir)
    flat = pages.withColumns({"variant": F.when(F.col("ocr_only"), "contrast").otherwise("original"), "confidence": 1 / F.col("page").cast("double")})
    return analysis.extract_flat(flat)


@query
def sha256_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), "text", "lang")
    expected = docs.select("path", F.sha2(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("x"))), 256).alias("sha256"))
    return driver.verified(docs.select("path", F.col("text").cast("binary").alias("content")), expected)
