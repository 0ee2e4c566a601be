"""Readers with fixed schemas: packets, spans, pages, records, labels, key lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlens.functions import vocab as V
from packetlens.operators.positions import numbered

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(), "decimal(6.2)": T.DecimalType(6, 2)}


def schema_of(fields: str) -> T.StructType:
    """A schema from ``name kind`` pairs, without a running session."""
    return T.StructType([T.StructField(n, _KINDS[k], True) for n, k in (f.split() for f in fields.split(", "))])


SPANS = schema_of("case_id string, page int, ord long, text string, x0 double, y0 double, x1 double, y1 double, size double, color int, source string")
PAGES = schema_of("case_id string, page int, width double, height double, text string")
IMAGES = schema_of("case_id string, page int, img_no int, width int, height int, channels int, content binary")
RASTERS = schema_of("case_id string, page int, dpi int, content binary")
VIEWS = schema_of("case_id string, page int, img_no int, content binary")
ERRORS = schema_of("case_id string, error string")
READS = schema_of("case_id string, page int, crop int, text string")
WORDS = schema_of(
    "case_id string, source string, page_num string, block_num string, par_num string, line_num string, left string, top string, width string, height string, conf string, text string"
)
OCR_PAGES = schema_of("case_id string, page int, variant string, text string, confidence double")
CANDIDATES = schema_of("case_id string, field string, rank decimal(6.2), value string, source string, at long")
RECORDS = T.StructType([T.StructField(f, T.DoubleType() if f == "confidence" else T.StringType(), True) for f in V.RECORD_FIELDS])
TRUTH = schema_of("case_id string, adjudication string, risk_flags string, fee_status string, visa_class string, sponsor_id string, species_code string, home_world string")


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder: path, case_id (the file's stem), length, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("case_id"), "length", "content")


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def truth(spark: SparkSession, path: str, schema: T.StructType = TRUTH) -> DataFrame:
    """A CSV with a header; columns go by name, not by place."""
    # The header names the columns; a schema alone would go by place.
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).json(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    """OCR words as tab-separated values with a header, all strings."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def case_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, case_id) of a text file with one key a line; blank lines don't count."""
    rows = spark.read.text(path).select(F.trim("value").alias("case_id")).where("case_id != ''")
    return numbered(rows).select("pos", "case_id")


def span_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Span files as they arrive."""
    return spark.readStream.schema(SPANS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

