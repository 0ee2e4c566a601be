"""Drawn pages, kept by content: a page is drawn once for each content of its packet and each resolution, in whatever run.

The store is a folder of committed runs for each resolution, its rows (sha256,
page, content). A pass joins the pages it wants against the keys there, draws
what is missing, and adds it as a run of its own; a run that fails adds nothing
and is made up for by the next. A page that can't be drawn is kept as null, so
it isn't tried again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adapters import OCR_DPI, render_pages
from .commits import Folder
from .readers import RASTERS, schema_of

STORED = schema_of("sha256 string, page int, content binary")


def stored(folder: Folder) -> DataFrame:
    """All drawn pages with the number of their run. Two runs at a time may have drawn a page twice."""
    spark = folder.spark
    numbers = {r.path.rsplit("/", 1)[1]: r.number for r in folder.runs()}
    rows = folder.read(lambda paths: spark.read.schema(STORED).parquet(*paths), spark.createDataFrame([], STORED))
    if not numbers:
        return rows.withColumn("run", F.lit(0).cast("long"))
    names = spark.createDataFrame(list(numbers.items()), "name string, run long")
    return rows.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -2)).join(F.broadcast(names), "name").drop("name")


def _once(rows: DataFrame) -> DataFrame:
    """Each page of the store once, from its first run; only keys are shuffled for it if no page is there twice."""
    keys = rows.groupBy("sha256", "page").agg(F.min("run").alias("run"), F.count(F.lit(1)).alias("n"))
    twice = keys.where("n > 1").drop("n")
    if twice.isEmpty():
        return rows.drop("run")
    single = rows.join(twice.drop("run"), ["sha256", "page"], "left_anti")
    return single.unionByName(rows.join(twice, ["sha256", "page", "run"], "left_semi").dropDuplicates(["sha256", "page"])).drop("run")


def drawn_pages(packets: DataFrame, pages: DataFrame, dpi: int = OCR_DPI, folder: str | None = None) -> DataFrame:
    """Pages (case_id, page) of packets (case_id, path, sha256) drawn at ``dpi``; from ``folder`` what earlier runs drew.

    Packets of one content share their pages. Without a folder every page is drawn.
    """
    if folder is None:
        return render_pages(packets, pages, dpi)
    store = Folder(packets.sparkSession, f"{folder.rstrip('/')}/dpi={dpi}")
    wanted = pages.where("page is not null").select("case_id", F.col("page").cast("int").alias("page")).distinct().join(packets.select("case_id", "sha256"), "case_id")
    missing = wanted.join(stored(store).select("sha256", "page"), ["sha256", "page"], "left_anti").groupBy("sha256", "page").agg(F.min("case_id").alias("case_id"))
    missing = missing.persist()
    try:
        if not missing.isEmpty():
            new = render_pages(packets, missing.select("case_id", "page"), dpi)
            rows = missing.join(new.select("case_id", "page", "content"), ["case_id", "page"], "left").select(*STORED.names)
            store.commit(f"run-{uuid.uuid4().hex}", rows.write.parquet)
    finally:
        missing.unpersist()
    kept = _once(stored(store)).where("content is not null")
    return wanted.join(kept, ["sha256", "page"]).select("case_id", "page", F.lit(dpi).alias("dpi"), "content").select(*RASTERS.names)
