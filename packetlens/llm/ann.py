"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Unit vectors are rotated at random and dealt into lists by their nearest of some
centres, learned on a bounded sample. A query probes the lists of its nearest
centres. In a list the rotated vectors are read a block of columns at a time; a
hypothesis test on the partial distance abandons a candidate as soon as its
whole distance is very unlikely to beat the worst of the best found so far.
What survives is measured by the cosine of the original vectors in double
precision. Vectors are first scaled by a power of two, which changes no digit
of a cosine but keeps squares of very large and very small numbers finite.

The number of lists grows with the square root of the table, up to an eighth of
the sample. Lists and the queries that probe them are both cut into blocks, so
neither a long list nor one that all queries probe makes a long task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import arrow_map, written

#: Vectors of the sample on which centres and the number of probes are fitted; twice as many at most.
SAMPLE = 20_000
#: Vectors of a list, and queries that probe it, that meet in one group; larger lists have several.
BLOCK = 8192
ASKED = 4096
#: Queries and candidates whose partial distances are computed at once.
TILE = 256, 1024
COLUMNS = 16
#: Factor of the test: larger abandons less.
EPSILON = 2.1
TARGET_RECALL = 0.97
#: Queries and lists are probed until so many candidates are seen at least.
LEAST = 200


@dataclass
class ListIndex:
    """Rotation, centres, and how many lists a query probes."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    @property
    def dim(self) -> int:
        return len(self.rotation)

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
        return (unit @ self.rotation).astype(np.float32)

    def lists(self, rotated: np.ndarray) -> np.ndarray:
        return np.argmax(rotated @ self.centres.T, axis=1)

    def probed(self, rotated: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """The lists of each query: ``probes`` of them, and more until LEAST candidates are there."""
        order = np.argsort(-(rotated @ self.centres.T), axis=1, kind="stable")
        seen = np.cumsum(sizes[order], axis=1)
        n = np.maximum(self.probes, (seen < LEAST).sum(1) + 1)
        for row, k in zip(order, n, strict=True):
            yield row[:k]


def fit(sample: np.ndarray, total: int, k: int = 5, seed: int = 3) -> ListIndex:
    """An index from a sample of valid vectors, for ``total`` vectors in all."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    index = ListIndex(rotation, np.zeros((1, dim), np.float32), 1)
    if not len(sample):
        return index
    x = index.rotated(sample)
    kinds = np.unique(x, axis=0)
    n = max(1, int(min(np.sqrt(total), len(kinds) / 8)))
    centres = kinds[rng.choice(len(kinds), n, replace=False)]
    for _ in range(10):
        own = np.argmax(kinds @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, kinds)
        norm = np.sqrt((sums * sums).sum(1))
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], centres).astype(np.float32)
    index.centres = centres
    # Probes: as many as the sample's own neighbours need.
    ask = rng.choice(len(kinds), min(400, len(kinds)), replace=False)
    near = kinds[ask] @ kinds.T
    near[np.arange(len(ask)), ask] = -2
    k = min(k, len(kinds) - 1)
    if not k:
        return index
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(kinds[ask] @ centres.T), axis=1), axis=1)
    own = np.argmax(kinds @ centres.T, axis=1)
    depth = np.take_along_axis(place, own[best], axis=1).ravel()
    index.probes = int(np.quantile(depth, TARGET_RECALL)) + 1
    return index


def scan(queries: np.ndarray, rotated: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that the tests left: the ``k`` nearest rows of each query are very likely among them."""
    n, dim = rotated.shape
    first = min(n, 4 * k + 44)
    near = _distances(queries, rotated[:first])
    kept = [(np.repeat(np.arange(len(queries)), first), np.tile(np.arange(first), len(queries)))]
    best = np.sort(near, axis=1)[:, :k]
    rows = TILE[1]
    for begin in range(first, n, rows):
        block = rotated[begin : begin + rows]
        worst = best[:, -1]
        part = _distances(queries[:, :COLUMNS], block[:, :COLUMNS])
        q, x = np.nonzero(part <= _bound(worst, min(COLUMNS, dim), dim)[:, None])
        part = part[q, x]
        for c in range(COLUMNS, dim, COLUMNS):
            part = part + np.square(block[x, c : c + COLUMNS] - queries[q, c : c + COLUMNS]).sum(1)
            live = part <= _bound(worst, min(c + COLUMNS, dim), dim)[q]
            q, x, part = q[live], x[live], part[live]
        if len(q):
            kept.append((q, x + begin))
            best = _merged(best, q, part)
    return np.concatenate([q for q, _ in kept]), np.concatenate([x for _, x in kept])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _bound(worst: np.ndarray, read: int, dim: int) -> np.ndarray:
    """The partial distance over ``read`` of ``dim`` columns beyond which the whole one very likely exceeds ``worst``."""
    return (worst * (read / dim) * (1 + EPSILON / np.sqrt(read)) ** 2 if read < dim else worst) + 1e-5


def _merged(best: np.ndarray, q: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The smallest of each row's ``best`` and its new distances, in order."""
    k = best.shape[1]
    of = np.concatenate([np.repeat(np.arange(len(best)), k), q])
    d = np.concatenate([best.ravel(), distance])
    order = np.lexsort((d, of))
    first = np.searchsorted(of[order], np.arange(len(best)))
    return d[order][first[:, None] + np.arange(k)]


def valid(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, each scaled by a power of two so that its largest component lies between a half and 1."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])


def _raw(column: pd.Series, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim)


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each row of ``vectors`` where ``queries`` holds.

    Nearness is the largest cosine. Returns query_id, rank (from 1), vec_id, score;
    ties go to the smaller vec_id, and a row is never its own neighbour. Every
    valid row is indexed; each probed list is read in blocks, so a list with
    many copies of one vector is no larger task than others. All finite,
    non-zero vectors take part, however large or small their numbers are.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do null vec_ids, nor vectors of another length than the
    most frequent one. Rows that share a vec_id count once, by their best
    score. Other columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, total = lengths
    rows = rows.where(F.size("v") == dim)
    share = max(1, -(-total // SAMPLE))
    taken = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(share)) == 0).select("v").limit(2 * SAMPLE).toArrow()["v"]
    sample = np.concatenate([_matrix(c, dim) for c in taken.chunks] or [np.zeros((0, dim))])
    index = fit(sample, total, k)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            r = index.rotated(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(index.lists(r), pa.int32()), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in r], pa.binary())],
                names=["vec_id", "asks", "list", "v", "r"],
            )

    placed = written(arrow_map(rows, assign, "vec_id long, asks boolean, list int, v binary, r binary"), "lists")
    sizes = np.zeros(len(index.centres), np.int64)
    for row in placed.groupBy("list").count().collect():  # as many rows as centres
        sizes[row["list"]] = row["count"]
    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, dim)
            for begin in range(0, len(r), 256):
                at, lists = [], []
                for i, own in enumerate(index.probed(r[begin : begin + 256], sizes)):
                    at += [begin + i] * len(own)
                    lists += own.tolist()
                part = batch.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lists, pa.int32())], names=["query_id", "qv", "qr", "list"])

    asked = written(arrow_map(placed.where("asks").select("vec_id", "v", "r"), probe, "query_id long, qv binary, qr binary, list int"), "asked")
    probing = np.zeros(len(index.centres), np.int64)
    for row in asked.groupBy("list").count().collect():  # as many rows as centres at most
        probing[row["list"]] = row["count"]
    cut = spark.createDataFrame([(i, max(1, -(-int(n) // BLOCK)), max(1, -(-int(q) // ASKED))) for i, (n, q) in enumerate(zip(sizes, probing, strict=True))], "list int, n_blocks int, n_asked int")
    cut = F.broadcast(cut)  # as many rows as centres
    own_block = F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int").alias("block")
    own_asked = F.pmod(F.xxhash64("query_id"), F.col("n_asked")).cast("int").alias("part")
    there = placed.join(cut, "list").select("vec_id", "v", "r", "list", own_block, F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1)).alias("part"))
    asked = asked.join(cut, "list").select("query_id", "qv", "qr", "list", own_asked, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids = left["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            v, r = _raw(left["v"], dim, np.float64)[order], _raw(left["r"], dim, np.float32)[order]
            length = np.sqrt((v * v).sum(1))
            asking, qv, qr = right["query_id"].to_numpy(), _raw(right["qv"], dim, np.float64), _raw(right["qr"], dim, np.float32)
            q_length = np.sqrt((qv * qv).sum(1))
            for begin in range(0, len(asking), TILE[0]):
                q, x = scan(qr[begin : begin + TILE[0]], r, k + 1)
                q = q + begin
                other = ids[x] != asking[q]
                q, x = q[other], x[other]
                score = (v[x] * qv[q]).sum(1) / (length[x] * q_length[q])
                order = np.lexsort((ids[x], -score, q))
                q, x, score = q[order], x[order], score[order]
                first = np.searchsorted(q, q)
                best = np.arange(len(q)) - first < k
                out.append(pd.DataFrame({"query_id": asking[q[best]], "vec_id": ids[x[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = there.groupBy("list", "block", "part").cogroup(asked.groupBy("list", "block", "part")).applyInPandas(meet, "query_id long, vec_id long, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
