"""Hard negatives by bit-sliced integer products.

Components become integers. A candidate's integers are cut into bit planes,
the most significant first, and a plane's product with the anchor narrows the
interval in which the pair's score lies: what the lower planes may still add is
bounded by the sums of the anchor's positive and negative integers. A candidate
goes as soon as its interval can't reach what is wanted: for positives the
anchor's best so far, for negatives the range that its positives allow and the
best so far in it. After the last plane the intervals are the exact scores.

Anchors and candidates meet in blocks, so neither a hot label nor a long table
makes a long task; each block gives at most ``positives`` or ``negatives`` rows
for an anchor and a positive, and a window takes the best of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import arrow_map, small_batches, written

#: Candidates and anchors of a group; of a tile inside it.
BLOCK = 8192
ANCHORS = 1024
TILE = 1024
#: From this share of live pairs down, planes are multiplied pair by pair.
SPARSE = 0.05
#: Candidates kept for an anchor beyond any score: none yet.
LOWEST, HIGHEST = -(1 << 62), 1 << 62
#: The largest integer times the root of the length is below this, so that 64 bits hold a hundred times any score.
LARGEST = 1 << 28


class Planes:
    """Integer vectors as bit planes: ``low + sum of plane * 2 ** place``, with the most significant plane first."""

    def __init__(self, vectors: np.ndarray):
        self.low = int(vectors.min(initial=0))
        above = vectors - self.low
        self.places = list(range(int(above.max(initial=0)).bit_length()))[::-1]
        self.planes = [((above >> p) & 1).astype(np.uint8) for p in self.places]


def _sums(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)


def scores(anchors: np.ndarray, planes: Planes, rows: slice, live: np.ndarray, floor: np.ndarray, ceiling: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(anchor, candidate, score) of the pairs of ``live`` whose interval keeps to [floor, ceiling] after every plane; and how many plane products that took."""
    less, more = _sums(anchors)
    known = np.repeat(planes.low * anchors.sum(1)[:, None], live.shape[1], axis=1)
    wide = anchors.astype(np.float64)
    a = x = score = None
    work = 0
    for place, plane in zip(planes.places, planes.planes, strict=True):
        part, rest = plane[rows].astype(np.float64), (1 << place) - 1
        if a is None:
            known += (wide @ part.T).astype(np.int64) << place
            work += known.size
            live = live & (known + rest * more[:, None] >= floor[:, None])
            if ceiling is not None:
                live &= known + rest * less[:, None] <= ceiling[:, None]
            if live.mean() < SPARSE:
                a, x = np.nonzero(live)
                score = known[a, x]
        else:
            score = score + ((wide[a] * part[x]).sum(1).astype(np.int64) << place)
            work += len(a)
            kept = score + rest * more[a] >= floor[a]
            if ceiling is not None:
                kept &= score + rest * less[a] <= ceiling[a]
            a, x, score = a[kept], x[kept], score[kept]
    if a is None:
        a, x = np.nonzero(live)
        score = known[a, x]
    return a, x, score, work


def _best(keys: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each key, by score from the highest, then id."""
    order = np.lexsort((ids, -score, keys))
    sorted_keys = keys[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_keys, sorted_keys) < k]


def _raw(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dim).astype(np.int64)


def _distinct(ids: np.ndarray, label: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of rows that differ in id, label or vector: equal rows fall into one block, and count once."""
    order = np.lexsort((*v.T, label, ids))
    same = (ids[order][1:] == ids[order][:-1]) & (label[order][1:] == label[order][:-1]) & (v[order][1:] == v[order][:-1]).all(1)
    return np.sort(order[np.concatenate([[True], ~same])]) if len(ids) else order


def nearest_same(anchors: np.ndarray, anchor_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the first ``k`` rows of each anchor, all of one label; more may follow where scores tie."""
    planes, floor = Planes(v), np.full(len(anchors), LOWEST)
    found: list[tuple] = []
    for begin in range(0, len(v), TILE):
        rows = slice(begin, begin + TILE)
        other = ids[rows][None, :] != anchor_ids[:, None]
        a, x, score, _ = scores(anchors, planes, rows, other, floor)
        found.append((a, x + begin, score))
        a, x, score = (np.concatenate(c) for c in zip(*found, strict=True))
        top = _best(a, score, ids[x], k)
        a, x, score = a[top], x[top], score[top]
        found = [(a, x, score)]
        full = np.flatnonzero(np.bincount(a, minlength=len(anchors)) >= k)
        np.minimum.at(worst := np.full(len(anchors), HIGHEST), a, score)
        floor[full] = worst[full]
    return found[0] if found else (np.empty(0, np.int64),) * 3


def nearest_below(anchors: np.ndarray, labels: np.ndarray, wanted: np.ndarray, v: np.ndarray, ids: np.ndarray, other_labels: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, ...]:
    """(anchor, positive, row, score) of the first ``k`` rows of other labels for each score in ``wanted``, a row of them for each anchor, HIGHEST where there is none."""
    planes = Planes(v)
    given = wanted < HIGHEST
    least = np.where(given, -(-(percent * np.where(given, wanted, 0)) // 100), HIGHEST)  # the least integer that is percent of it
    ceiling = np.where(given, wanted, LOWEST).max(1)
    best = least.copy()
    n = wanted.shape[1]
    found: list[tuple] = []
    for begin in range(0, len(v), TILE):
        rows = slice(begin, begin + TILE)
        other = other_labels[rows][None, :] != labels[:, None]
        a, x, score, _ = scores(anchors, planes, rows, other, best.min(1), ceiling)
        pair, p = np.nonzero((score[:, None] >= best[a]) & (score[:, None] <= np.where(given[a], wanted[a], LOWEST)))
        found.append((a[pair] * n + p, x[pair] + begin, score[pair]))
        key, x, score = (np.concatenate(c) for c in zip(*found, strict=True))
        top = _best(key, score, ids[x], k)
        key, x, score = key[top], x[top], score[top]
        found = [(key, x, score)]
        full = np.bincount(key, minlength=best.size) >= k
        np.minimum.at(worst := np.full(best.size, HIGHEST), key, score)
        best = np.where(full.reshape(best.shape), worst.reshape(best.shape), least)
    key, x, score = found[0] if found else (np.empty(0, np.int64),) * 3
    return key // n, key % n, x, score


def integers(vectors: DataFrame, label: Column, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, label, dim, v: the rows that take part, their components as packed integers.

    Raises where 64 bits couldn't hold a score of so large integers.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            first = column.offsets.to_numpy()
            dims = np.diff(first)
            with np.errstate(over="ignore"):
                whole = np.floor(scale * column.flatten().to_numpy())
            if len(whole) and np.abs(whole).max() * np.sqrt(dims.max()) >= LARGEST:
                raise ValueError(f"components of {scale} * {np.abs(whole).max() / scale:.3g}: 64 bits can't hold a score")
            packed, first = whole.astype("<i4"), first - first[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array([packed[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())],
                names=["vec_id", "label", "dim", "v"],
            )

    return written(arrow_map(rows, run, "vec_id long, label long, dim int, v binary"), "integers")


def _dealt(candidates: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides in groups of ``keys``, block and part: every anchor meets every candidate of its keys once."""
    sizes = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(anchors.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
    cut = written(sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("n_blocks"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("n_parts")), "cut")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = candidates.join(cut, keys).withColumn("block", one_of("vec_id", "n_blocks")).withColumn("part", up_to("n_parts")).drop("n_blocks", "n_parts")
    right = anchors.join(cut, keys).withColumn("part", one_of("key", "n_parts")).withColumn("block", up_to("n_blocks")).drop("n_blocks", "n_parts")
    return left, right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own: both sides come from one table


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each anchor and each of its positives the first hard negatives.

    Components x become floor(scale * x); a score is the integer inner product
    with the anchor, and higher scores come first, ties by smaller vec_id. An
    anchor's positives are its first ``positives`` other rows of the same
    label; a positive's negatives the first ``negatives`` rows of another label
    with a score of at least ``percent`` of the positive's and at most the
    positive's. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. ``anchors`` says of a vec_id whether it is one.

    Rows with a null vec_id, label or vector, or a null or non-finite component
    take no part. Vectors meet vectors of their own length only. Rows equal in
    vec_id, label and integers count once; others that share a vec_id count
    each, but no row is an anchor's positive if it has the anchor's vec_id.
    Integers so large that 64 bits couldn't hold a score raise an error. Other
    columns are ignored. An empty table gives an empty result.
    """
    rows = integers(vectors, label, scale, vec_id, embedding)
    asked = rows.where(F.coalesce(anchors, F.lit(False))).dropDuplicates(["vec_id", "label", "dim", "v"])
    asked = asked.select(F.xxhash64("vec_id", "label", "dim", "v").alias("key"), F.col("vec_id").alias("anchor_id"), "label", "dim", F.col("v").alias("a"))

    def same(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "vec_id": [], "score": []}).astype("int64")
        dim = int(right["dim"].iloc[0])
        v, ids = _raw(left["v"], dim), left["vec_id"].to_numpy()
        one = _distinct(ids, left["label"].to_numpy(), v)
        v, ids = v[one], ids[one]
        a, x, score = nearest_same(_raw(right["a"], dim), right["anchor_id"].to_numpy(), v, ids, positives)
        return pd.DataFrame({"key": right["key"].to_numpy()[a], "vec_id": ids[x], "score": score})

    left, right = _dealt(rows, asked, ["label", "dim"])
    keys = ("label", "dim", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(same, "key long, vec_id long, score long")
    near = _first(found, ["key"], positives)
    near = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))  # ``positives`` rows at most
    near = near.select("key", F.col("near.vec_id").alias("near_ids"), F.col("near.score").alias("near_scores"))
    wanted = written(asked.join(near, "key"), "positives")

    def below(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "positive", "positive_id", "positive_score", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names}).astype("int64")
        dim = int(right["dim"].iloc[0])
        v, ids, labels = _raw(left["v"], dim), left["vec_id"].to_numpy(), left["label"].to_numpy()
        one = _distinct(ids, labels, v)
        v, ids, labels = v[one], ids[one], labels[one]
        score, who = np.full((len(right), positives), HIGHEST), np.zeros((len(right), positives), np.int64)
        for i, (near_ids, near_scores) in enumerate(zip(right["near_ids"], right["near_scores"], strict=True)):
            who[i, : len(near_ids)], score[i, : len(near_ids)] = near_ids, near_scores
        a, p, x, got = nearest_below(_raw(right["a"], dim), right["label"].to_numpy(), score, v, ids, labels, negatives, percent)
        return pd.DataFrame({"key": right["key"].to_numpy()[a], "positive": p, "positive_id": who[a, p], "positive_score": score[a, p], "vec_id": ids[x], "score": got})

    left, right = _dealt(rows, wanted, ["dim"])
    keys = ("dim", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(below, "key long, positive long, positive_id long, positive_score long, vec_id long, score long")
    hard = _first(found, ["key", "positive"], negatives)
    hard = hard.join(wanted.select("key", "anchor_id"), "key")
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
