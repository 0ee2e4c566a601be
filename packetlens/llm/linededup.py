"""Line deduplication by overlapping three-line windows, on DataFrame functions alone.

Every three consecutive non-blank lines of a document are hashed. Of windows
with the same lines the first, by (doc_id, position), stays; the lines of every
later one go, where it doesn't overlap the first. What several removed windows
cover goes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import spare

#: Places in the order of windows are doc_id * PLACES + index of the window in its document.
PLACES = 1 << 31


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """A row for each window: its two hashes, its place in the order, its first and last line."""
    lines = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, r"[\t\r]", " ")).alias("x")))
    full = rows.select("doc_id", "digest", F.filter(lines, lambda s: s["x"] != "").alias("full"))
    full = full.where(F.size("full") >= width)
    part = lambda j, k: F.element_at("full", j + k)["x"]
    window = lambda j: F.struct(
        F.xxhash64(*(part(j, k) for k in range(width))).alias("h1"),
        F.xxhash64(F.lit(width), *(part(j, k) for k in reversed(range(width)))).alias("h2"),
        j.alias("j"),
        F.element_at("full", j)["i"].alias("first"),
        F.element_at("full", j + (width - 1))["i"].alias("last"),
    )
    seen = full.select("doc_id", "digest", F.explode(F.transform(F.sequence(F.lit(1), F.size("full") - (width - 1)), window)).alias("w")).select("doc_id", "digest", "w.*")
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")).cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("j").cast("decimal(11,0)")
    return seen.withColumn("place", place.cast("decimal(38,0)"))


def dedup_lines(docs: DataFrame, width: int = 3, n_removed: str = "n_removed", n_lines: str = "n_lines") -> DataFrame:
    """``docs`` with repeated windows of ``width`` lines cut from ``text``.

    ``docs``: doc_id, text and any other columns, which stay as they are. Two
    columns are added, named by ``n_lines`` and ``n_removed``; if ``docs`` has
    such a name already, underscores are put before it.

    Lines compare without surrounding white space; blank lines belong to no
    window and stay. A null text stays null with 0 lines; an empty one has one
    blank line. Texts with fewer than ``width`` lines have no window and stay
    whole. Rows that share a doc_id count as one document: neither is taken for
    a later copy of the other at the same position; equal rows get equal results. A null doc_id
    comes before all others. An empty table gives an empty one.
    """
    digest, cut, cut_id = spare(docs, "_digest"), spare(docs, "_cut"), spare(docs, "_cut_id")
    keyed = docs.withColumn(digest, F.xxhash64("text", F.length("text")))
    rows = keyed.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(digest).alias("digest"), "text")
    windows = _windows(rows, width)
    first = windows.groupBy("h1", "h2").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("h1", "h2", "first_place")
    later = windows.join(first, ["h1", "h2"]).where(F.col("place") - F.col("first_place") >= width)
    gone = later.groupBy(F.col("doc_id").alias(cut_id), F.col("digest").alias(f"{cut}_digest")).agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias(cut))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col(cut_id)) & (F.col(digest) == F.col(f"{cut}_digest")), "left")
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n"))
    rest = [F.col(c) if c.lower() != "text" else text.alias(c) for c in docs.columns]
    return joined.select(
        *rest,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(spare(docs, n_lines)),
        F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long").alias(spare(docs, n_removed)),
    )


#: The same in DuckDB SQL over the table ``{docs}`` (doc_id, text).
SQL = """
WITH ln AS (
  SELECT doc_id, text, hash(text) AS digest, unnest(string_split(text, chr(10))) AS x,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM {docs} WHERE text IS NOT NULL),
ln2 AS (
  SELECT doc_id, text, i, trim(regexp_replace(x, '[\\t\\r]', ' ', 'g')) AS t FROM ln
  WHERE trim(regexp_replace(x, '[\\t\\r]', ' ', 'g')) <> ''),
w0 AS (
  SELECT doc_id, i AS first_, t AS a, lead(t, 1) OVER w AS b, lead(t, 2) OVER w AS c, lead(i, 2) OVER w AS last_,
         row_number() OVER w AS j
  FROM ln2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT *, doc_id::HUGEINT * 2147483648 + j AS place FROM w0 WHERE c IS NOT NULL),
f AS (SELECT a, b, c, min(place) AS first_place FROM w GROUP BY a, b, c HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first_, last_ + 1)) AS i
  FROM w JOIN f USING (a, b, c) WHERE place - first_place >= 3),
kept AS (
  SELECT ln.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY ln.i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM ln LEFT JOIN gone ON ln.doc_id = gone.doc_id AND ln.i = gone.i GROUP BY ln.doc_id)
SELECT {columns} FROM {docs} d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
