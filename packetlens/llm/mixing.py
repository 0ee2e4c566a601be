"""Mixing sources to target weights by entropy balancing.

Among all document rates ``r`` between 0 and ``cap`` the mix has the one closest
to 1 in relative entropy whose token sums meet each source's target. Its dual
has one multiplier a source, and the rates are ``min(cap, exp(lambda * size /
mean size))``. The dual is convex; Newton's method, kept inside a bracket,
solves it. Each iteration sums tokens and slopes over (source, size) cells on
the executors; the driver holds one number a source, as it holds the weights.

Rates become whole copies by carrying the rounding rest from cell to cell,
largest sizes first, so a source misses its target by less than its smallest
documents. Which documents of a cell get one copy more follows their exact
places in the order of a hash: a cell is ranked in hashed parts, and prefix
sums over the sizes of the parts turn ranks into places of the whole cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import n_words, written

#: Documents that one task ranks together; results don't depend on it.
PART = 500
TOLERANCE = 1e-9
MAX_STEPS = 80


def cycle_weights(names: list[str | None], weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> dict[str | None, float]:
    """Sources by code point, null last, take the weights in turn."""
    ordered = sorted((n for n in names if n is not None)) + [n for n in names if n is None]
    return {n: weights[i % len(weights)] for i, n in enumerate(ordered)}


def fill_targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Shares of ``total`` by weight; above ``cap`` times the size they stop, and the others share the rest."""
    targets: dict = {}
    left, open_ = float(total), [k for k in sizes]
    while open_:
        whole = sum(weights[k] for k in open_)
        share = {k: (left * weights[k] / whole if whole else 0.0) for k in open_}
        over = [k for k in open_ if share[k] > cap * sizes[k]]
        if not over:
            return targets | share
        for k in over:
            targets[k] = float(cap * sizes[k])
            left -= targets[k]
        open_ = [k for k in open_ if k not in targets]
    return targets


def _solve(cells: DataFrame, sizes: dict, counts: dict, targets: dict, cap: float) -> dict:
    """Multiplier of each source, as (lambda, mean size); None where the rate is 0."""
    spark = cells.sparkSession
    top = math.log(cap)
    mean = {k: sizes[k] / counts[k] for k in sizes if sizes[k] > 0}
    low, high, lam, done = {}, {}, {}, {}
    for k, m in mean.items():
        if targets[k] <= 0:
            done[k] = None
        elif targets[k] >= cap * sizes[k]:
            done[k] = top * m
        else:
            low[k], high[k], lam[k] = -60.0 * m, top * m, 0.0
    for _ in range(MAX_STEPS):
        if not lam:
            break
        rows = [(k, lam[k], mean[k]) for k in lam]
        step = spark.createDataFrame(rows, "source string, lam double, mean double").alias("s")
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(top)))
        mass = F.col("n") * F.col("size")
        sums = (
            cells.join(step, cells["source"].eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("k"))
            .agg(F.sum(mass * rate).alias("g"), F.sum(F.when(F.col("lam") * z < top, mass * z * rate).otherwise(0.0)).alias("h"))
            .collect()
        )
        for k, g, h in sums:
            gap = g - targets[k]
            if abs(gap) <= TOLERANCE * targets[k]:
                done[k] = lam.pop(k)
                continue
            if gap > 0:
                high[k] = lam[k]
            else:
                low[k] = lam[k]
            new = lam[k] - gap / h if h > 0 else math.inf
            lam[k] = new if low[k] < new < high[k] else (low[k] + high[k]) / 2
    done |= lam
    return {k: (done[k], mean[k]) for k in mean}


def _to_copies(cap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        copies, rest = [], 0.0
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"], strict=True):
            if size <= 0:
                copies.append(0)
                continue
            want = n * rate * size + rest
            k = max(0, min(cap * int(n), int((want + 1e-6) // size)))
            rest = want - k * size
            copies.append(k)
        return pdf.assign(k=copies)[["source", "size", "n", "k"]].astype({"k": "int64"})

    return run


def mix(
    docs: DataFrame,
    weights: Callable[[list], dict] = cycle_weights,
    share: float = 1.5,
    cap: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Copies of each document, so that sources meet their targets.

    ``docs``: doc_id, source, text; other columns are ignored, but for those that
    ``keep`` names (no column of the result), which stay. ``weights`` maps the
    list of sources to their weights. Returns doc_id, source, size, source_size,
    target, copies, taken (``copies * size``), and what ``keep`` names.

    Null and empty texts have size 0 and take 0 words with 0 copies. A null
    source is a source of its own. Repeated rows count as documents of their
    own. An empty table gives an empty result. Rounding depends on doc_id and
    size alone, so reruns agree.
    """
    spark = docs.sparkSession
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *keep), "sizes")
    cells = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    # One row a source: a catalogue to which the caller gives weights.
    found = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n")).collect()
    sizes = {r["source"]: int(r["tokens"]) for r in found}
    counts = {r["source"]: int(r["n"]) for r in found}
    targets = fill_targets(sizes, weights(list(sizes)), share * sum(sizes.values()), cap)
    solved = _solve(cells, sizes, counts, targets, float(cap))
    rows = [(k, sizes[k], float(targets[k]), *(solved.get(k) or (None, 1.0))) for k in sizes]
    plan = spark.createDataFrame(rows, "src string, source_size long, target double, lam double, mean double")
    rated = cells.join(plan, cells["source"].eqNullSafe(plan["src"])).select(
        "source", "size", "n", F.coalesce(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))), F.lit(0.0)).alias("rate")
    )
    copies = rated.groupBy("source").applyInPandas(_to_copies(cap), "source string, size long, n long, k long")
    copies = written(copies.withColumnRenamed("source", "c_source").withColumnRenamed("size", "c_size"), "copies")
    part = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / PART)))
    placed = written(sized.join(copies, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))).withColumn("part", part).drop("c_source", "c_size"), "placed")
    # Places before each part: a row a part, so a cell of n documents has n / PART.
    parts = placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("own"))
    before = F.sum("own").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), F.coalesce(before, F.lit(0)).alias("before"))
    same = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id", *keep))
    placed = placed.join(parts, same).withColumn("place", F.col("before") + rank)
    base = F.floor(F.col("k") / F.col("n"))
    given = base + F.when(F.col("place") <= F.col("k") - base * F.col("n"), 1).otherwise(0)
    placed = placed.withColumn("copies", given.cast("long"))
    return placed.join(plan, placed["source"].eqNullSafe(plan["src"])).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
