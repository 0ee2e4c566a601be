"""OCR output as relations: words to lines, guards between retries, merged spans.

A word row: case_id, source, page_num, block_num, par_num, line_num, left, top,
width, height, conf, text, all but the keys as strings. A line row: case_id,
page, source, text, confidence, x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from packetlens.functions import patterns as P
from packetlens.functions import text as T
from packetlens.functions import vocab as V

LINE_KEYS = ("page_num", "block_num", "par_num", "line_num")

# Words that show a faint risk mark.
RISK_WORDS = ("biohazard", "warrant", "tampering", "embargo", "rescind", "illegible")

# Sources of OCR spans, in the order in which a page is read.
ORIGINAL, CONTRAST_RISK, FEE_CROP, FEE_SPARSE = "ocr:original", "ocr:contrast_risk", "ocr:fee_crop", "ocr:fee_psm11"
HEADER, HEADER_SPARSE, MID_SPARSE = "ocr:embedded_header", "ocr:embedded_psm11", "ocr:embedded_mid_psm11"
SOURCES = (ORIGINAL, CONTRAST_RISK, FEE_CROP, FEE_SPARSE, HEADER, HEADER_SPARSE, MID_SPARSE)


def words_to_lines(words: DataFrame, keys: tuple[str, ...] = ("case_id",), tie: tuple[str, ...] = ()) -> DataFrame:
    """Groups words into physical lines.

    Blank words, and words whose numbers can't be read or whose confidence is
    negative, are left out. Words stand by their left edge (then by ``tie``, then text).
    """
    number = lambda c, kind: F.col(c).try_cast(kind)
    rows = words.select(
        *keys,
        *LINE_KEYS,
        *tie,
        F.trim("text").alias("word"),
        (number("conf", "double") / 100).alias("conf"),
        number("left", "int").alias("x0"),
        number("top", "int").alias("y0"),
        (number("left", "int") + number("width", "int")).alias("x1"),
        (number("top", "int") + number("height", "int")).alias("y1"),
    ).where("word != '' AND conf >= 0 AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", *tie, "word"))), lambda w: w["word"]), " ")
    return rows.groupBy(*keys, *LINE_KEYS).agg(
        said.alias("text"), T.exact_mean(F.col("conf")).alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def mean_confidence(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean confidence for each of ``keys``; 0 where no line has one."""
    return lines.groupBy(*keys).agg(F.coalesce(T.exact_mean(F.col("confidence")), F.lit(0.0)).alias("confidence"))


def has_risk_word(text: Column) -> Column:
    return T.any_of(*(F.contains(F.lower(text), F.lit(w)) for w in RISK_WORDS))


def faint_pages(pages: DataFrame, original: DataFrame) -> DataFrame:
    """Of ``pages`` (case_id, page) those whose original lines show no risk word: the contrast retry reads them."""
    return pages.join(original.where(has_risk_word(F.col("text"))).select("case_id", "page").distinct(), ["case_id", "page"], "left_anti")


def contrast_lines(original: DataFrame, retry: DataFrame) -> DataFrame:
    """Lines of the contrast retry that show a risk word, on pages whose original shows none."""
    return faint_pages(retry.where((F.col("confidence") >= V.RETRY_CONFIDENCE) & has_risk_word(F.col("text"))), original)


def fee_crop_pages(original: DataFrame) -> DataFrame:
    """(case_id, page) with a receipt's title but no line that gives a fee status."""
    page = original.groupBy("case_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda r: r["text"]), " ").alias("all"),
        F.bool_or(T.fee(F.col("text")).isNotNull()).alias("readable"),
    )
    return page.where(T.matches(F.lower("all"), P.RECEIPT_TITLE, T.EXACT) & ~F.col("readable")).select("case_id", "page")


def band_images(images: DataFrame, side: int = V.BAND_SIDE) -> DataFrame:
    """Images of which bands are read: both sides reach ``side``."""
    return images.where((F.col("width") >= side) & (F.col("height") >= side))


def sparse_lines(reads: DataFrame, source: str) -> DataFrame:
    """Whole texts of sparse reads (case_id, page, text) as line rows without a place of their own; blank ones go."""
    said = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    corner = [F.lit(v).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))]
    return reads.select("case_id", "page", F.lit(source).alias("source"), said.alias("text"), F.lit(1.0).alias("confidence"), *corner).where("text != ''")


def to_spans(lines: DataFrame, least: float = V.OCR_CONFIDENCE) -> DataFrame:
    """Lines as spans, where confident enough."""
    return lines.where(F.col("confidence") >= least).select(
        "case_id", "page", F.row_number().over(_reading()).alias("ord"), "text", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(9.0).alias("size"), F.lit(0).alias("color"), "source"
    )


def _reading() -> WindowSpec:
    ladder = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return Window.partitionBy("case_id", "page").orderBy(ladder, "source", "y0", "x0", "text")


def evidence_spans(text_layer: DataFrame, original: DataFrame, retry: DataFrame, fee_lines: DataFrame, bands: DataFrame) -> DataFrame:
    """Text-layer spans and every OCR span that the guards let through.

    The four OCR relations are line rows with their ``source``; ``fee_lines``
    holds reads of the fee crop, ``bands`` of embedded images. They stand in the
    order of ``SOURCES``, after the page's text layer.
    """
    crop = fee_lines.join(fee_crop_pages(original), ["case_id", "page"], "left_semi")
    found = to_spans(original.unionByName(contrast_lines(original, retry)).unionByName(crop).unionByName(bands))
    return text_layer.unionByName(found.withColumn("ord", F.col("ord") + 1_000_000))


def distinct_texts(reads: DataFrame, keys: list[str], order: str = "crop") -> DataFrame:
    """Reads of several crops joined by line feeds, each distinct text (stripped) once, in order."""
    rows = reads.where(F.trim("text") != "").groupBy(*keys, F.trim("text").alias("said")).agg(F.min_by("text", order).alias("text"), F.min(order).alias("at"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda r: r["text"]), "\n").alias("text"))
