"""The corpus pipeline: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, with n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm import decontaminate, jaccard, linededup, mixing, quality
from packetlens.llm.runtime import drop_since, few, made, spare, table, written

#: The classifier's score from which a document is kept.
KEEP_SCORE = 0.7
#: Shingle words and percent of similarity that make two documents near copies.
SHINGLE, PERCENT = 5, 80
#: Similarity of a window to a benchmark item that makes a document a leak.
LEAK = 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below KEEP_SCORE.

    Null and empty texts are scored like others; equal texts go or stay
    together; repeated rows stay as often as they come. An empty table gives an
    empty one, and without labels every score is one half, so all go.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = spare(docs, "score")
    return quality.score(docs, model, score).where(F.col(score) >= KEEP_SCORE).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of three-line windows; a document of which nothing but blanks is left goes.

    A null or empty text stays as it is, and so does a repeated row: rows that
    share a doc_id are one document. An empty table gives an empty one.
    """
    lines, removed = spare(docs, "n_lines"), spare(docs, "n_removed")
    cut = linededup.dedup_lines(docs, n_removed=removed, n_lines=lines)
    cut = cut.where((F.col(removed) == 0) | (F.trim(F.regexp_replace("text", r"\s", " ")) != ""))
    n_chars = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select([n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of similar documents; equal rows once; rows without a doc_id stay."""
    groups = jaccard.similar(docs, SHINGLE, PERCENT)
    heads = written(groups.where("doc_id = component_id").select("doc_id").distinct(), "heads")
    kept = docs.join(few(heads), "doc_id", "left_semi")
    if docs.where("doc_id is not null").count() > docs.agg(F.count_distinct("doc_id")).first()[0]:
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window that repeats a benchmark item.

    Null and empty texts stay; repeated rows go or stay together. An empty
    table, or an empty benchmark, drops nothing.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), LEAK)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the copies that the mix takes of each: columns of documents, then size, source_size, target, copies, taken.

    Null and empty texts have size 0 and 0 copies; a null source is a source of
    its own. Equal rows all get the largest number of copies that one of them has.
    An empty table gives an empty one.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    digest = spare(docs, "_digest")
    told = docs.withColumn(digest, F.xxhash64("text", F.length("text")))
    mixed = mixing.mix(told, keep=(digest,)).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col(digest).alias("_told")).agg(*(F.max(c).alias(c) for c in added))
    same = told["doc_id"].eqNullSafe(mixed["_id"]) & told["source"].eqNullSafe(mixed["_source"]) & (told[digest] == mixed["_told"])
    return told.join(mixed, same).select(*docs.columns, *(mixed[c] for c in added))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
]

#: SQL can't express the learned classifier, so a brute-force version in the tests stands in.
ORACLE_SQL = None


def taken(mixed: DataFrame) -> DataFrame:
    """The mix in effect: every row of the last stage as often as ``copies`` says, and none of 0."""
    return mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy := spare(mixed, "_copy"))).drop(copy)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left, once each, with the copies that the mix takes of them; ``taken`` puts these into effect."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = made()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_since(before, made() - 1)  # what the stage kept for itself; its output is the last
    return docs
