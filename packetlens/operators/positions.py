"""Global positions without one task: ranges in order, a count of each, and a rank inside.

Ranges of the order are sorted side by side. Their counts, as many as there are
partitions, give the position at which each range begins; the position of a row
is that and its place in the range. No step has a single partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.lineage import settle

#: Rows of one partition are numbered from its number times this.
_STRIDE = 1 << 33


def _begins(counts: dict[int, int]) -> dict[int, int]:
    parts = sorted(counts)
    return dict(zip(parts, accumulate((counts[p] for p in parts), initial=0), strict=False))


def _position(begins: dict[int, int], at: Column) -> Column:
    begin = F.create_map(*(F.lit(x).cast("long") for pair in begins.items() for x in pair)) if begins else F.create_map().cast("map<bigint,bigint>")
    return F.element_at(begin, F.shiftright(at, 33)) + F.pmod(at, F.lit(_STRIDE))


def numbered(rows: DataFrame, name: str = "pos") -> DataFrame:
    """``rows`` with the position of each in the order of their partitions, from 0. The partitions must come alike whenever they are computed, as those of a scan do."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    counts = placed.groupBy(F.shiftright("_at", 33).alias("part")).count()
    begins = _begins({r["part"]: r["count"] for r in counts.collect()})  # as many rows as partitions
    return placed.withColumn(name, _position(begins, F.col("_at"))).drop("_at")


def sliced(rows: DataFrame, order: list[str], start: int, limit: int | None = None, name: str = "_pos") -> DataFrame:
    """The rows at positions ``start`` to ``start + limit`` in an order, with their position; only ranges that the slice touches are read again."""
    at = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33))
    kept = settle(ranged, by=("_part",))
    counts = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}  # as many rows as partitions
    begins = _begins(counts)
    end = sum(counts.values()) if limit is None else start + limit
    touched = [p for p, begin in begins.items() if begin < end and begin + counts[p] > start]
    inside = kept.where(F.col("_part").isin(*touched)) if touched else kept.limit(0)
    placed = inside.withColumn(name, _position(begins, F.col("_at")))
    return placed.where((F.col(name) >= start) & (F.col(name) < end)).drop("_at", "_part")
