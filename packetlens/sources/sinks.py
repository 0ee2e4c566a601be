"""Sinks: JSON lines with sorted keys, overwritten, appended, or committed as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.operators.driver import json_line

from .commits import Folder
from .readers import RECORDS


def write_records(records: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> None:
    """Records in the order of case_id, one JSON object a line.

    The range shuffle keeps the order across files, so the parts read in order
    are the whole in order; ``files=1`` gives a single file. A reader that comes
    meanwhile may see a part; ``commit_records`` writes so that none does.
    """
    ordered = records.repartitionByRange(files, "case_id") if files else records.repartitionByRange("case_id")
    lines = ordered.sortWithinPartitions("case_id").select(json_line(records.columns).alias("value"))
    lines.write.mode(mode).text(path)


def append_records(records: DataFrame, path: str) -> None:
    """Adds records to a folder; run again after a failure it may add them twice, unlike ``commit_records``."""
    write_records(records, path, "append")


def commit_records(records: DataFrame, path: str, run: str, files: int | None = None, replace: bool = False) -> bool:
    """Adds records to a folder of committed runs, all or none; a run that is there already isn't written again (false).

    With ``replace`` they take the place of all runs before.
    """
    return Folder(records.sparkSession, path).commit(run, lambda own: write_records(records, own, "error", files), replace)


def committed_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all runs that count."""
    return Folder(spark, path).read(lambda paths: spark.read.schema(RECORDS).json(paths), spark.createDataFrame([], RECORDS))


def write_pages(pages: DataFrame, path: str) -> None:
    """One JSON object a case with its pages nested, in order."""
    rest = [c for c in pages.columns if c not in ("case_id", "page")]
    nested = pages.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("page", *rest))).alias("pages"))
    nested.write.mode("overwrite").json(path)
