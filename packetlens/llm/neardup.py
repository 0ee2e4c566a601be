"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors are sorted by some concatenated random hashes: a hash
is the one of ``AXES`` random directions, or their opposites, that lies nearest
to the vector. Similar vectors share the first hashes often, so they come to lie
side by side; each vector is compared with the ``WINDOW`` that follow it. The
chance that a pair of the least similarity shares a hash depends on that
similarity alone, and it says how many passes leave fewer than ``MISSED`` of
such pairs apart. A pass carries vectors of a byte a component, with the length
of the rounding error: most pairs are linked or not whatever the error, and the
others are verified on whole vectors. Links are united across the passes.

Equal vectors are one from the start, with their number. Windows can't see all
pairs of a large group, so the links inside each component are counted apart:
a small one whole, a large one in shells by the angle to its mean direction.
Two shells whose angles add up to less than the threshold's are linked
throughout, and such links are counted without looking at a pair; shells whose
angles differ by more aren't linked at all; only what lies between is compared,
block by block. So a group of close copies costs its size and not its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import valid
from .components import components
from .runtime import arrow_map, small_batches, written

#: Vectors that follow in the order with which each is compared, and random directions of a hash.
WINDOW = 16
AXES = 64
#: Share of pairs of the least similarity that the passes may miss, and the passes that there are at least.
MISSED = 0.0005
PASSES = 4
#: Vectors of a component that is compared whole, and of a block of a larger one.
BLOCK = 2048
#: Shells of a large component: so many to a right angle, and the slack for rounded angles and products.
SHELLS = 180
SLACK = 1e-7


def chance(least: float, seed: int = 11, n: int = 20_000) -> float:
    """How likely two vectors of cosine ``least`` share a hash: their parts along random directions are normal numbers of that correlation."""
    rng = np.random.default_rng(seed)
    x, e = rng.normal(size=(2, n, AXES))
    return float((_axis(x) == _axis(least * x + math.sqrt(max(0.0, 1 - least * least)) * e)).mean())


def orders(total: int, least: float) -> tuple[int, int]:
    """Passes, and hashes of each, for ``total`` vectors: hashes until no more share them than a window holds, passes until few pairs were always apart."""
    needed = math.log(max(total / WINDOW, 1.0)) / math.log(2 * AXES)
    once = min(chance(least) ** needed, 1 - 1e-9)
    return max(PASSES, math.ceil(math.log(MISSED) / math.log(1 - once))), min(8, math.ceil(needed) + 1)


def _axis(parts: np.ndarray) -> np.ndarray:
    at = np.abs(parts).argmax(1)
    return 2 * at + (parts[np.arange(len(parts)), at] > 0)


def directions(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng((17, number)).normal(size=(dim, AXES)).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors; a power of two first keeps the squares of very large and very small numbers finite."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, initial=0))[1][:, None])
    return v / np.sqrt((v * v).sum(1))[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _packed(v: np.ndarray) -> pa.Array:
    return _binary(np.ascontiguousarray(v, "<f8").view(np.uint8).reshape(len(v), -1))


def _raw(column: Iterable[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, dim)


def least_of_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least node of each group that the edges (a, b) make, one from each other node: as many links, far fewer edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def sketch(u: np.ndarray) -> np.ndarray:
    """Rows of bytes: a scale, the length of the rounding error, a byte a component."""
    scale = (np.abs(u).max(1, initial=0) / 127).astype(np.float32)
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.sqrt(np.square(u - q * scale[:, None].astype(np.float64)).sum(1)).astype(np.float32) * np.float32(1.0001)
    return np.concatenate([scale.view(np.uint8).reshape(-1, 4), error.view(np.uint8).reshape(-1, 4), q.view(np.uint8)], axis=1)


def _sketches(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded vectors and the lengths of their errors."""
    head = np.ascontiguousarray(raw[:, :8]).view(np.float32)
    return raw[:, 8:].view(np.int8) * head[:, :1], head[:, 1]


def _bytes(column: Iterable[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _orders(dim: int, passes: int, hashes: int):
    """A row for each vector and pass: the pass, the hashes as one key, the vector's sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = [[directions(dim, p * 8 + h) for h in range(hashes)] for p in range(passes)]
        for batch in batches:
            u = _raw(batch.column(1).to_pylist(), dim)
            small, rows = u.astype(np.float32), _binary(sketch(u))
            for p in range(passes):
                key = np.zeros(len(u), np.int64)
                for turn in turns[p]:
                    key = key * (2 * AXES) + _axis(small @ turn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), p, np.int32)), pa.array(key), batch.column(0), rows], names=["pass", "key", "node", "q"])

    return run


def pairs(turn: np.ndarray, node: np.ndarray, raw: np.ndarray, least: float, first: int, behind: int = 0) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of each row from ``first`` on with one of the ``WINDOW`` before it in its pass, and pairs that only whole vectors can judge.

    With ``behind``, the earlier row of a pair is one of the first ``behind``.
    """
    u, error = _sketches(raw)
    sure: list[tuple] = [(node[:0], node[:0])]
    open_ = list(sure)
    for d in range(1, min(WINDOW, len(node) - 1) + 1):
        begin = max(first, d)
        end = min(len(node), behind + d) if behind else len(node)
        if begin >= end:
            continue
        x, y = slice(begin, end), slice(begin - d, end - d)
        cosine = np.einsum("ij,ij->i", u[x], u[y])
        slack = error[x] + error[y] * (1 + error[x]) + 1e-5
        there = (turn[x] == turn[y]) & (cosine >= least - slack)
        sure_ = there & (cosine >= least + slack)
        sure.append((node[x][sure_], node[y][sure_]))
        open_.append((node[x][there & ~sure_], node[y][there & ~sure_]))
    return tuple(np.concatenate(c) for c in zip(*sure, strict=True)), tuple(np.concatenate(c) for c in zip(*open_, strict=True))


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_()), ("part", pa.int32()), ("place", pa.int32()), ("pass", pa.int32()), ("q", pa.binary())])
OUT = "a long, b long, open boolean, part int, place int, pass int, q binary"


def _found(sure: tuple[np.ndarray, np.ndarray], open_: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and whether they are open: linked ones thinned, the others each once."""
    a, b = least_of_groups(*sure)
    x, y = np.unique(np.stack([np.maximum(*open_), np.minimum(*open_)]), axis=1)
    return np.concatenate([a, x]), np.concatenate([b, y]), np.repeat([False, True], [len(a), len(x)])


def _border(turn: np.ndarray, node: np.ndarray, raw: np.ndarray, part: int, first: int) -> pa.RecordBatch:
    n = len(node)
    places = np.arange(first, first + n, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, part, np.int32)), pa.array(places), pa.array(turn), _binary(raw)], schema=_OUT)


def _windows(dim: int, least: float):
    """Compares sorted rows with those before them; the first and last rows of a partition also go out, for the border to its neighbours."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head = TaskContext.get().partitionId(), 0
        kept = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, dim + 8), np.uint8))
        for batch in batches:
            own = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bytes(batch.column(2).to_pylist(), dim + 8))
            if head < WINDOW and len(own[0]):
                n = min(WINDOW - head, len(own[0]))
                yield _border(*(x[:n] for x in own), part - 1, WINDOW + head)
                head += n
            rows = tuple(np.concatenate([k, x]) for k, x in zip(kept, own, strict=True))
            a, b, open_ = _found(*pairs(*rows, least, len(kept[0])))
            nothing = [pa.nulls(len(a), f.type) for f in list(_OUT)[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(open_), *nothing], schema=_OUT)
            kept = tuple(x[-WINDOW:] for x in rows)
        if len(kept[0]):
            yield _border(*kept, part, WINDOW - len(kept[0]))

    return run


def links(nodes: DataFrame, dim: int, total: int, least: float) -> DataFrame:
    """(a long, b long): pairs that some pass finds, thinned to what unites the same nodes. ``nodes``: node, u (unit vectors of ``dim`` doubles).

    A window doesn't reach beyond a partition of fewer rows than it holds.
    """
    passes, hashes = orders(total, least)
    rows = arrow_map(nodes.select("node", "u"), _orders(dim, passes, hashes), "pass int, key long, node long, q binary")
    tie = F.xxhash64("node", "pass")  # vectors of one key lie in any order, and are dealt over partitions
    rows = rows.withColumn("tie", tie).repartitionByRange("pass", "key", "tie").sortWithinPartitions("pass", "key", "tie")
    out = written(arrow_map(rows.select("pass", "node", "q"), _windows(dim, least), OUT), "windows")

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("place")
        before = int((x["place"] < WINDOW).sum())
        if not 0 < before < len(x):
            return pd.DataFrame({"a": [], "b": [], "open": []}).astype({"a": "int64", "b": "int64", "open": "bool"})
        a, b, open_ = _found(*pairs(x["pass"].to_numpy(), x["a"].to_numpy(), _bytes(x["q"], dim + 8), least, before, before))
        return pd.DataFrame({"a": a, "b": b, "open": open_})

    over = out.where("part is not null").select("a", "part", "place", "pass", "q").groupBy("part").applyInPandas(meet, "a long, b long, open boolean")  # two windows of rows at most
    found = written(out.where("part is null").select("a", "b", "open").unionByName(over).distinct(), "pairs")
    maybe = found.where("open").select("a", "b")
    left = nodes.select(F.col("node").alias("a"), F.col("u").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("u").alias("y"))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.einsum("ij,ij->i", _raw(batch.column(2).to_pylist(), dim), _raw(batch.column(3).to_pylist(), dim))
            yield batch.select(["a", "b"]).filter(pa.array(cosine >= least))

    if maybe.isEmpty():
        return found.select("a", "b")
    verified = arrow_map(maybe.join(left, "a").join(right, "b").select("a", "b", "x", "y"), verify, "a long, b long")
    return found.where("not open").select("a", "b").unionByName(verified)


def _whole(dim: int, least: float):
    """Weights of the links of each node, in components of at most ``BLOCK`` nodes that come one after the other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(rows: pa.Table) -> pa.RecordBatch:
            group, node, n, u = rows["component"].to_numpy(), rows["node"].to_numpy(), rows["n"].to_numpy(), _raw(rows["u"].to_pylist(), dim)
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            out = np.zeros(len(node), np.int64)
            for a, b in zip(first, first[1:], strict=False):
                linked = u[a:b] @ u[a:b].T >= least
                np.fill_diagonal(linked, False)
                out[a:b] = linked @ n[a:b]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(out)], names=["node", "linked"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            group = rows["component"].to_numpy()
            last = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last component may go on in the next batch
            if last:
                yield close(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
        if held and sum(map(len, held)):
            yield close(pa.Table.from_batches(held))

    return run


def _means(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            sums = np.zeros((len(group), dim))
            np.add.at(sums, place, _raw(batch.column(1).to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([pa.array(group), _packed(sums)], names=["component", "sums"])

    return run


def _angles(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return 2 * np.arcsin(np.minimum(np.sqrt(np.square(u - mean).sum(1)) / 2, 1))


def _inside_large(members: DataFrame, dim: int, least: float) -> DataFrame:
    """(node, linked) of components of more than ``BLOCK`` nodes. ``members``: component, node, n, u."""
    theta = math.acos(min(1.0, max(-1.0, least)))
    width = math.pi / 2 / SHELLS

    def total(x: pd.DataFrame) -> pd.DataFrame:
        mean = _raw(x["sums"], dim).sum(0)
        length = math.sqrt(float(mean @ mean))
        mean = mean / length if length > 1e-9 else np.eye(1, dim)[0]
        return pd.DataFrame({"component": [x["component"].iloc[0]], "mean": [mean.astype("<f8").tobytes()]})

    sums = arrow_map(members.select("component", "u"), _means(dim), "component long, sums binary")  # one row a batch and component
    means = written(sums.groupBy("component").applyInPandas(total, "component long, mean binary"), "means")

    def shells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, mean = _raw(batch.column(3).to_pylist(), dim), _raw(batch.column(4).to_pylist(), dim)
            shell = np.floor(_angles(u, mean) / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shell)], names=["component", "node", "n", "u", "shell"])

    placed = members.join(means, "component").select("component", "node", "n", "u", "mean")
    placed = written(arrow_map(placed, shells, "component long, node long, n long, u binary, shell int"), "shells")
    counts = placed.groupBy("component", "shell").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("weight"))
    counts = written(counts.withColumn("blocks", F.ceil(F.col("nodes") / BLOCK).cast("int")), "shell-counts")
    mine = counts.select("component", F.col("shell").alias("s"), F.col("blocks").alias("s_blocks"))
    other = counts.select("component", F.col("shell").alias("t"), F.col("weight").alias("t_weight"), F.col("blocks").alias("t_blocks"))
    shell_pairs = mine.join(other, "component")  # a component has 2 * SHELLS shells at most
    certain = (F.col("s") + F.col("t") + 2) * width < theta - SLACK
    never = (F.abs(F.col("s") - F.col("t")) - 1) * width > theta + SLACK
    sure = shell_pairs.where(certain).groupBy("component", F.col("s").alias("shell")).agg(F.sum("t_weight").alias("sure"))
    inner = F.col("shell") * 2 + 2  # a shell that is linked throughout with itself counts every node once too often
    own = F.when(inner * width < theta - SLACK, F.col("n")).otherwise(F.lit(0))
    by_bound = placed.select("component", "node", "n", "shell").join(sure, ["component", "shell"]).select("node", (F.col("sure") - own).cast("long").alias("linked"))

    between = written(shell_pairs.where(~certain & ~never).select(F.col("component").alias("c"), "s", "t", "s_blocks", "t_blocks"), "between")
    one_of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = placed.join(between, (F.col("component") == F.col("c")) & (F.col("shell") == F.col("s"))).select("c", "s", "t", "node", "u", one_of("s_blocks").alias("x"), up_to("t_blocks").alias("y"))
    asked = placed.join(between, (F.col("component") == F.col("c")) & (F.col("shell") == F.col("t"))).select("c", "s", "t", "node", "n", "u", up_to("s_blocks").alias("x"), one_of("t_blocks").alias("y"))
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))  # columns of its own: both sides come from one table

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "linked": []}).astype("int64")
        a, b, v, n = left["node"].to_numpy(), right["node"].to_numpy(), _raw(right["u"], dim), right["n"].to_numpy()
        u = _raw(left["u"], dim)
        linked = np.concatenate([((u[i : i + 512] @ v.T >= least) & (a[i : i + 512, None] != b[None, :])) @ n for i in range(0, len(u), 512)])
        return pd.DataFrame({"node": a, "linked": linked})

    keys = ("c", "s", "t", "x", "y")
    compared = asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(compare, "node long, linked long")
    return by_bound.unionByName(compared).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link where their cosine, in double precision, is ``least`` or more.
    ``n_links``: other vectors linked directly; ``component_id``: the smallest
    vec_id that links reach, its own included; ``kept``: whether the two are one.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths. Every row counts as
    a vector, so a repeated row links with its like; rows of one vec_id share
    no component because of it. A null vec_id gives a null component unless
    links reach one that isn't, and is kept. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(valid(F.col("v")), F.col("v")))
    key = [F.xxhash64("v", F.lit(seed)).alias(name) for seed, name in ((1, "h"), (2, "i"))]
    own = rows.where("v is not null").select("vec_id", "v", *key)
    same = own.groupBy("h", "i").agg(F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = same.select("h", "i", "head", "n", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node"))
    classes = written(classes, "classes")
    found = None
    for dim, total in classes.groupBy("dim").count().orderBy("dim").collect():  # lengths of vectors, seldom more than one
        told = _links_of(classes.where(F.col("dim") == dim), dim, total, least)
        found = told if found is None else found.unionByName(told)
    known = classes.select("h", "i", "node", "n", "head")
    if found is not None:
        known = written(known.join(found, "node", "left").drop("node"), "known")
        groups = known.where("component is not null").groupBy("component").agg(F.min("head").alias("least"))
        known = known.join(groups, "component", "left")
        known = known.select("h", "i", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "head").alias("of"))
    else:
        known = known.select("h", "i", F.lit(0).cast("long").alias("links"), F.col("head").alias("of"))
    all_rows = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1))).alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(2))).alias("i"))
    component = F.coalesce("of", "vec_id")
    return all_rows.join(known, ["h", "i"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def _links_of(classes: DataFrame, dim: int, total: int, least: float) -> DataFrame:
    """(node, component, linked) of the nodes that link with others: the weight of these."""

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(_matrix(batch.column(2), dim))], names=["node", "n", "u"])

    nodes = written(arrow_map(classes.select("node", "n", "v"), units, "node long, n long, u binary"), "units")
    edges = links(nodes, dim, total, least)
    of = components(edges).select(F.col("id").alias("node"), "component")
    members = written(nodes.join(of, "node").select("component", "node", "n", "u"), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK)
    large = written(sizes.select("component"), "large")
    small = members.join(large, "component", "left_anti").repartition("component").sortWithinPartitions("component", "node")
    counted = arrow_map(small.select("component", "node", "n", "u"), _whole(dim, least), "node long, linked long")
    if not large.isEmpty():
        counted = counted.unionByName(_inside_large(members.join(large, "component", "left_semi"), dim, least))
    return of.join(counted, "node")
