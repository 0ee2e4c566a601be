"""N-gram Jaccard join: documents whose shingle sets are similar, as components.

Documents with the same set become one representative. Two sets of the wanted
similarity share an element among the first few of each in any fixed order
(``prefix_length``), so representatives meet in blocks, one for each element of
a prefix. The order puts elements that a bounded sample shows to be frequent
last, which keeps frequent passages out of the prefixes; any sample gives the
same links.

Blocks only say which points meet; every candidate comes from a search of a
count-vector R-tree. First the points that share a block with its smallest id
form a tree, which that id searches: pairs whose summed coordinate minima reach
the wanted overlap are verified on the sets, and links give components. Blocks
that hold several components are then joined, each point searching the tree of
the others, and pairs of different components that the bounds leave are
verified too. So all links between components are found, while a group of
copies never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .counttree import LEAF, CountTree, count_vector, fold, n_groups, packed, passes, unpacked
from .runtime import arrow_map, few, small_batches, written
from .tokens import Piece, gram_hash, grams, mix64, pieces

#: A block with more members is joined piece by piece.
BLOCK = 4096
SAMPLE = 12_000
HEAVY = 200_000
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(piece: Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order of text, then hash; and each text's first (their number last).

    A text of fewer than ``k`` words has its whole sequence as its only shingle.
    """
    h = piece.hashes()
    g, text = grams(h, piece.first, k)
    n = np.diff(piece.first)
    for short in range(1, k):
        which = np.flatnonzero(n == short)
        if len(which):
            at = piece.first[:-1][which]
            g = np.concatenate([g, gram_hash([h[at + j] for j in range(short)])])
            text = np.concatenate([text, which])
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    g, text = g[new], text[new]
    return g, np.searchsorted(text, np.arange(piece.n_texts + 1))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _signer(k: int, percent: int, heavy: np.ndarray, weight: np.ndarray):
    """For each document: size and digest of its set, its prefix, its count vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                g, first = shingle_sets(piece, k)
                n = np.diff(first)
                text = np.repeat(np.arange(len(n)), n)
                late = np.zeros(len(g), np.int64)
                if len(heavy) and len(g):
                    at = np.minimum(np.searchsorted(heavy, g), len(heavy) - 1)
                    late = np.where(heavy[at] == g, weight[at], 0)
                order = np.lexsort((g, late, text))
                length = np.where(n > 0, prefix_length(n, percent), 0)
                taken = np.arange(len(g)) - np.repeat(first[:-1], n) < np.repeat(length, n)
                keys = g[order][taken].view(np.int64)
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(g ^ s), dtype=np.uint64)]) for s in (_SALT, ~_SALT)]
                    d1, d2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                vectors = [packed(count_vector(g[first[i] : first[i + 1]])) if n[i] else b"" for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.rows.start, piece.n_texts),
                        pa.array(n, pa.int64()),
                        pa.array(d1),
                        pa.array(d2),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(keys)),
                        pa.array(vectors, pa.binary()),
                    ],
                    names=["doc_id", "n", "d1", "d2", "keys", "vector"],
                )

    return run


def _sample_grams(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(piece, k)[0].view(np.int64))], names=["g"])

    return run


def frequent(docs: DataFrame, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen in three or more documents of a sample of about SAMPLE, at most HEAVY of them, with their counts. Only the order of elements depends on them."""
    sample = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // SAMPLE))) == 0) & (F.length("text") <= 200_000)).select("text").limit(4 * SAMPLE)
    found = arrow_map(sample, _sample_grams(k), "g long").groupBy("g").count().where("count >= 3").orderBy(F.desc("count"), "g").limit(HEAVY).collect()
    g = np.array([r["g"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(g)
    return g[order], np.array([r["count"] for r in found], np.int64)[order]


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key another row has."""
    keep_k, keep_i, opened = np.empty(0, np.int64), np.empty(0, np.int64), False
    names = ["key", "id"]
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.concatenate([keep_k, batch.column(0).to_numpy(zero_copy_only=False)])
        i = np.concatenate([keep_i, batch.column(1).to_numpy(zero_copy_only=False)])
        same = k[1:] == k[:-1]
        before = np.concatenate([[opened], same])
        many = before | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(k[:-1][many[:-1]]), pa.array(i[:-1][many[:-1]])], names=names)
        keep_k, keep_i, opened = k[-1:], i[-1:], bool(before[-1])
    if opened:
        yield pa.RecordBatch.from_arrays([pa.array(keep_k), pa.array(keep_i)], names=names)


def _vectors(column: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    return [unpacked(v, n_groups(n)) for v, n in zip(column, sizes.tolist(), strict=True)]


def _fits(a: np.ndarray, b: np.ndarray, sizes: int, percent: int) -> bool:
    m = min(len(a), len(b))
    return bool(passes(np.minimum(fold(a, m), fold(b, m)).sum(), sizes, percent))


def _tree_join(percent: int):
    """Blocks sorted by key (key, one, two, id, component, n, vector, chunk) to pairs of different components within bounds: points of chunk ``one`` make the tree, those of ``two`` search it."""

    def join(rows: list[tuple], one: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids = np.array([r[0] for r in rows])
        comp = np.array([r[1] for r in rows])
        size = np.array([r[2] for r in rows])
        vec = _vectors([r[3] for r in rows], size)
        chunk = np.array([r[4] for r in rows])
        if (comp == comp[0]).all():
            return
        own = np.flatnonzero(chunk == one)
        other = own if (chunk == one).all() else np.flatnonzero(chunk != one)
        if not len(own):
            return
        tree = CountTree([vec[i] for i in own], size[own])
        step = 16 * LEAF
        for s in range(0, len(other), step):
            part = other[s : s + step]
            q, p = tree.search([vec[i] for i in part], size[part], percent)
            x, y = part[q], own[p]
            good = comp[x] != comp[y]
            if other is own:
                good &= x < y
            x, y = x[good], y[good]
            fine = np.fromiter((_fits(vec[i], vec[j], size[i] + size[j], percent) for i, j in zip(x, y, strict=True)), bool, len(x))
            yield np.minimum(ids[x], ids[y])[fine], np.maximum(ids[x], ids[y])[fine]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                for a, b in join(rows, now[1]):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for key, one, two, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, one, two) != now:
                    yield from flush()
                    now, rows = (key, one, two), []
                rows.append(row)
        yield from flush()

    return run


def _setter(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                g, first = shingle_sets(piece, k)
                sets = [g[first[i] : first[i + 1]].tobytes() for i in range(piece.n_texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.rows.start, piece.n_texts), pa.array(sets, pa.binary())], names=["id", "elements"])

    return run


def _verifier(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                at = np.minimum(np.searchsorted(y, x), len(y) - 1) if len(y) else np.empty(0, np.int64)
                both = int((y[at] == x).sum()) if len(y) else 0
                keep[i] = bool(passes(np.array(both), len(x) + len(y), percent)) and both > 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets reach the similarity, compared whole."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    sets = arrow_map(docs.select("doc_id", "text").join(few(ids), "doc_id", "left_semi"), _setter(k), "id long, elements binary")
    sets = written(sets, "sets")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    return written(arrow_map(joined.select("a", "b", "x", "y"), _verifier(percent), "a long, b long").distinct(), "links")


def similar(documents: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Size of each document's shingle set, and the component that links put it in.

    ``documents``: doc_id, text; other columns are ignored. Words are split at
    ASCII white space, A-Z lower-cased; a set has the distinct ``k``-word
    shingles, or with fewer words the whole sequence as one. Two documents link
    when 100 * intersection >= ``percent`` * union. Returns a row for each row of
    ``documents``: doc_id, n_shingles, class_id (smallest doc_id with the same
    set), component_id (smallest doc_id reachable by links).

    Null and empty texts have no shingles, link with nothing, and are their own
    component. Rows that share a doc_id go by their own texts. A null doc_id
    keeps its row, with a null component, and links nothing. An empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heavy, weight = frequent(docs.where("text is not null"), k, docs.count())
    signed = written(arrow_map(docs, _signer(k, percent, heavy, weight), "doc_id long, n long, d1 long, d2 long, keys array<long>, vector binary"), "signed")
    classes = written(signed.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = signed.join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", "n", "d1", "d2"], "left_semi")
    rows = heads.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    blocks = written(arrow_map(rows.repartition("key").sortWithinPartitions("key", "id"), _shared, "key long, id long"), "blocks")

    # Blocks with the same members are one.
    member = F.xxhash64("id").cast("decimal(20,0)")
    stats = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(member).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.min("id").alias("center"))
    kept = stats.groupBy("members", "s", "x").agg(F.min("key").alias("key"), F.min("center").alias("center")).select("key", "center", "members")
    blocks = written(blocks.join(kept, "key").select("key", "id", "center", "members"), "kept")
    known = few(written(blocks.select(F.col("id").alias("doc_id")).distinct(), "members"))
    points = written(heads.join(known, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "vector"), "points")

    def searched(placed: DataFrame) -> DataFrame:
        rows = placed.join(points, "id").select("key", "one", "two", "id", "component", "n", "vector", "chunk")
        rows = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
        return arrow_map(rows, _tree_join(percent), "a long, b long").distinct()

    # The points that meet a smallest id make trees, in pieces; it searches each.
    met = written(blocks.where("id != center").select(F.col("center").alias("key"), "id").distinct(), "met")
    cut = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    met = met.join(cut, "key").select("key", "id", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).cast("long").alias("component"))
    asks = cut.select("key", F.col("key").alias("id"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("one"), F.lit(0).cast("long").alias("component"), F.lit(-1).alias("chunk"))
    met = met.withColumn("one", F.col("chunk")).unionByName(asks).withColumn("two", F.lit(-1))
    tried = written(searched(met), "stars")
    links = _verified(docs, tried, k, percent)
    joined = components(links)

    # Blocks of several components: every pair that bounds allow between them. Pairs with the center have been tried.
    placed = blocks.where("members > 2 AND id != center").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi and hi is not null").select("key")
    chunks = F.ceil(F.col("members") / BLOCK)
    placed = placed.join(open_, "key", "left_semi").withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    placed = placed.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")})
    pairs = written(searched(placed).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = _verified(docs, pairs, k, percent)
    final = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(final, classes["class_id"] == final["id"], "left").select("n", "d1", "d2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2", F.when(F.col("doc_id").isNotNull(), F.col("n")).alias("n")).join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
