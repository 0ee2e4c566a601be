"""Operators on positioned text spans.

A span row: case_id, page, ord, text, x0, y0, x1, y1, size, color, source.
``ord`` is the reading order inside a page; every choice below that depends on
order uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.functions import vocab as V


def visible(spans: DataFrame) -> DataFrame:
    """Spans whose ink can be seen: neither white nor tiny."""
    return spans.where((F.col("color") != V.WHITE) & (F.col("size") >= V.MIN_SIZE))


def inside(spans: DataFrame, pages: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Spans within the rectangle of their page. ``pages``: case_id, page, width, height."""
    fits = (F.col("x0") >= -tolerance) & (F.col("y0") >= -tolerance) & (F.col("x1") <= F.col("width") + tolerance) & (F.col("y1") <= F.col("height") + tolerance)
    return spans.join(pages.select("case_id", "page", "width", "height"), ["case_id", "page"]).where(fits).select(spans.columns)


def without_decoys(spans: DataFrame) -> DataFrame:
    return spans.where(~T.decoy_span(F.col("text")))


def trusted(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """The text layer as evidence: visible, inside the page, no decoys, white space collapsed."""
    seen = without_decoys(inside(visible(spans), pages))
    return seen.withColumn("text", T.collapse(F.col("text"))).where("text != ''")


def joined(order: list[str], text: str = "text", separator: str = " ") -> Column:
    """Ordered concatenation of a group's texts."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("said"))))
    return F.array_join(F.transform(rows, lambda r: r["said"]), separator)


def page_texts(spans: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """(case_id, page, text, ocr_only, rank): what each page says, and how strong its kind of page is as evidence.

    Spans of one place, as of packets that share a case_id, stand by ``tie``, then text.
    """
    pages = spans.groupBy("case_id", "page").agg(joined(["ord", *tie]).alias("text"), F.bool_and(F.startswith("source", F.lit("ocr:"))).alias("ocr_only"))
    return pages.withColumn("rank", T.source_rank(F.col("text")))


def page_layout(spans: DataFrame) -> DataFrame:
    """(case_id, page, text, body): what each page says, and whether any of it is of body size, in one grouping."""
    return spans.groupBy("case_id", "page").agg(joined(["ord"]).alias("text"), F.bool_or(has_body()).alias("body"))


def case_texts(spans: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """(case_id, text) of all spans in order; those of one place stand by ``tie``, then text."""
    return spans.groupBy("case_id").agg(joined(["page", "ord", *tie]).alias("text"))


#: Height of a band of a page, and how many bands a label looks up one by one; more are found by passing over the page's bands.
BAND, LOOKED_UP = 8.0, 16


def right_cells(spans: DataFrame, labels: Column) -> DataFrame:
    """(case_id, page, ord, value): the nearest cell to the right of each span where ``labels`` holds.

    A page's cells are put into bands by their top edge, and each label looks
    only into the bands that its height reaches: one grouping by page, no join.
    The smallest gap wins, then the smaller x0, then reading order.
    """
    keys = ["case_id", "page"]
    band = lambda y: F.floor(y / BAND).cast("long")
    rows = spans.select(*keys, "ord", "text", "x0", "x1", "y0", "size", labels.alias("label")).repartition(*keys)
    label = F.when(F.coalesce("label", F.lit(False)), F.struct("ord", "text", "x0", "x1", "y0", "size"))
    banded = rows.groupBy(*keys, band(F.col("y0")).alias("band")).agg(F.collect_list(F.struct("x0", "y0", "ord", "text")).alias("cells"), F.collect_list(label).alias("labels"))
    bands = F.map_from_entries(F.collect_list(F.when(F.col("band").isNotNull(), F.struct("band", "cells"))))
    pages = banded.groupBy(*keys).agg(bands.alias("bands"), F.flatten(F.collect_list("labels")).alias("labels")).where(F.size("labels") > 0)
    one = pages.select(*keys, "bands", F.explode("labels").alias("l"))
    at = lambda c: F.col(f"l.{c}")
    reach = F.greatest(F.lit(7.0), at("size"))
    low, high = band(at("y0") - reach), band(at("y0") + reach)
    some = F.when(high - low < LOOKED_UP, F.sequence(low, high)).otherwise(F.filter(F.map_keys("bands"), lambda b: b.between(low, high)))
    gap = F.greatest(F.lit(15.0), (at("x1") - at("x0")) * 0.25)
    near = lambda c: (F.abs(c["y0"] - at("y0")) <= reach) & (c["x0"] >= at("x1") + gap) & (c["text"] != at("text"))
    cells = F.flatten(F.transform(some, lambda b: F.filter(F.coalesce(F.element_at("bands", b), F.array().cast("array<struct<x0:double,y0:double,ord:bigint,text:string>>")), near)))
    best = F.array_min(F.transform(cells, lambda c: F.struct((c["x0"] - at("x1")).alias("gap"), c["x0"].alias("x0"), c["ord"].alias("ord"), c["text"].alias("text"))))
    return one.select(*keys, at("ord").alias("ord"), best["text"].alias("value")).where("value is not null")


def has_body() -> Column:
    """Whether a span is of body size and no footer."""
    return (F.col("size") >= V.MEANINGFUL_SIZE) & ~F.startswith("text", F.lit("Packet ")) & (T.fold(F.col("text")) != V.FOOTER)


def meaningful_pages(spans: DataFrame) -> DataFrame:
    """(case_id, page) with a span of body size that is no footer."""
    return spans.where(has_body()).select("case_id", "page").distinct()


def footer_pages(pages: DataFrame) -> DataFrame:
    """(case_id, page) whose plain ``text`` has nothing but a footer."""
    return pages.where(T.footer_only(F.col("text"))).select("case_id", "page")


def image_pages(images: DataFrame, side: int = V.IMAGE_SIDE) -> DataFrame:
    """(case_id, page) with an image whose longer side reaches ``side``."""
    return images.where(F.greatest("width", "height") >= side).select("case_id", "page").distinct()


def pages_to_ocr(pages: DataFrame, spans: DataFrame | None, images: DataFrame) -> DataFrame:
    """(case_id, page): pages without meaningful text, footer pages, and pages with a large image.

    The relations meet in one grouping by page; nothing is joined. Without
    ``spans`` the pages themselves say whether they have a ``body`` (``page_layout``).
    """
    keys = ["case_id", "page"]
    no = F.lit(False)
    marks = pages.select(*keys, F.lit(True).alias("listed"), (F.col("body") if spans is None else no).alias("body"), T.footer_only(F.col("text")).alias("asks"))
    marks = marks.unionByName(images.select(*keys, no.alias("listed"), no.alias("body"), (F.greatest("width", "height") >= V.IMAGE_SIDE).alias("asks")).where("asks"))
    if spans is not None:
        marks = marks.unionByName(spans.select(*keys, no.alias("listed"), has_body().alias("body"), no.alias("asks")).where("body"))
    seen = marks.groupBy(*keys).agg(*(F.bool_or(c).alias(c) for c in ("listed", "body", "asks")))
    return seen.where("asks OR (listed AND NOT coalesce(body, false))").select(*keys)


def oracle_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(case_id, page) that an outside reader sees: pages with an image, and every first page even without one."""
    keys = ["case_id", "page"]
    return pages.where("page = 1").select(keys).unionByName(pages.select(keys).join(images.select(keys).distinct(), keys, "left_semi")).distinct()


def audit_pages(pages: DataFrame, images: DataFrame, to_ocr: DataFrame, needs: DataFrame) -> DataFrame:
    """(case_id, page) to audit for unknown fields.

    ``needs``: case_id, need_risk. All pages when risk is unknown or nothing is
    selected; else unread pages, pages with images, pages with telling words.
    """
    keys = ["case_id", "page"]
    said = T.any_of(*(F.contains(F.lower("text"), F.lit(w)) for w in V.AUDIT_WORDS))
    told = pages.where(said).select(keys)
    chosen = to_ocr.select(keys).unionByName(images.select(keys)).unionByName(told).distinct().withColumn("hit", F.lit(True))
    marked = pages.select(keys).join(needs, "case_id").join(chosen, keys, "left")
    some = marked.groupBy("case_id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("some"))
    return marked.join(some, "case_id").where(F.col("need_risk") | ~F.col("some") | F.col("hit")).select(keys)
