"""Readers that lose nothing: what can't be read goes to a relation of its own, with its file and line.

A line's number is its place in its split and the lines of the file's splits
before it, which are counted first; a file is never read by one task for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import RECORDS, TRUTH

REJECTS = "file string, line long, text string, reason string"


@dataclass(frozen=True)
class Checked:
    """Rows that could be read, and those that couldn't: file, line (from 1), text, reason."""

    rows: DataFrame
    rejects: DataFrame


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of every line of text files, lines from 1."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    other = splits.select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("n").alias("m"))
    before = splits.join(other, (F.col("file") == F.col("f")) & (F.col("b") < F.col("block")), "left").groupBy("file", "block", "first").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    placed = rows.join(before, ["file", "block"])  # as many rows as splits
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def _told(rows: DataFrame, reason) -> DataFrame:
    return rows.select("file", "line", "text", F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"))


def _misfits(schema: T.StructType, said: str) -> Column:
    """Why a row of strings doesn't fit ``schema``: its first column whose text isn't of the column's type; else null."""
    wrong = [F.when(F.col(f"{said}.`{f.name}`").isNotNull() & F.col(f"{said}.`{f.name}`").try_cast(f.dataType).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")) for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    return F.coalesce(*wrong, F.lit(None).cast("string"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType = RECORDS) -> Checked:
    """Rows of JSON lines by name. A line that is cut, is no object, or has a value of another type is rejected; blank lines don't count."""
    corrupt = "_corrupt"
    loose = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields), T.StructField(corrupt, T.StringType())])
    rows = lines(spark, path).where(F.trim("text") != "")
    said = rows.withColumn("said", F.from_json("text", loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    broken = F.col("said").isNull() | F.col(f"said.{corrupt}").isNotNull() | ~F.startswith(F.ltrim("text"), F.lit("{"))
    reason = F.when(broken, F.lit("no JSON object")).otherwise(_misfits(schema, "said"))
    judged = said.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(*(F.col(f"said.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields))
    return Checked(good, _told(judged.where("reason IS NOT NULL"), F.col("reason")))


def csv_rows(spark: SparkSession, path: str, schema: T.StructType = TRUTH) -> Checked:
    """Rows of CSV files with headers, columns by name; each file by its own header.

    A file that lacks a wanted column is rejected with its header line, and its
    rows have null there. A row of more or fewer fields than the header, or with
    a value of another type, is rejected. Quoted fields hold no line feeds.
    """
    rows = lines(spark, path)
    heads = [(r["file"], r["text"]) for r in rows.where("line = 1").collect()]  # as many rows as files
    body = rows.where("line > 1").where(F.trim("text") != "")
    goods, bads = [], [spark.createDataFrame([], REJECTS)]
    by_head: dict[str, list[str]] = {}
    for file, head in heads:
        by_head.setdefault(head, []).append(file)
    for head, files in by_head.items():  # files of one header are read together
        names = [n.strip() for n in _fields(head)]
        missing = [f.name for f in schema.fields if f.name not in names]
        if missing:
            bads.append(spark.createDataFrame([(f, 1, head, f"no column {', '.join(missing)}") for f in files], REJECTS))
        own = body.where(F.col("file").isin(*files))
        loose = ", ".join(f"`{i}` string" for i in range(len(names))) + ", _corrupt string"
        said = own.withColumn("read", F.from_csv("text", F.lit(loose), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
        said = said.withColumn("said", F.struct(*((F.col(f"read.`{names.index(f.name)}`") if f.name in names else F.lit(None).cast("string")).alias(f.name) for f in schema.fields)))
        reason = F.when(F.col("read._corrupt").isNotNull(), F.lit(f"not {len(names)} fields")).otherwise(_misfits(schema, "said"))
        judged = said.withColumn("reason", reason)
        goods.append(judged.where("reason IS NULL").select(*(F.col(f"said.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields)))
        bads.append(_told(judged.where("reason IS NOT NULL"), F.col("reason")))
    good = spark.createDataFrame([], schema)
    for g in goods:
        good = good.unionByName(g)
    bad = bads[0]
    for b in bads[1:]:
        bad = bad.unionByName(b)
    return Checked(good, bad)


def _fields(line: str) -> list[str]:
    import csv

    return next(csv.reader([line]), [])
