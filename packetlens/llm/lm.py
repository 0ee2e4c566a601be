"""Language-model scoring: interpolated modified Kneser-Ney, counted in Spark, memory-mapped by workers.

Training counts words, then pairs, then longer grams up to the model's order, a
pass over the texts for each, and sums counts by context and by what a gram
ends in. Grams of a level are numbered by their place in its sorted arrays, and
a gram of the next level is a pair of such numbers in one 64-bit key: that of
its context, and that of itself without its first word. So every level is
counted, stored and looked up as pairs are. The highest level has counts; lower
ones have how many different words come before a gram, or, where a text's start
comes before it and nothing else can, its count.

Tasks send each other sorted, compressed tables of counts, one for each part of
the key space, so a hot word or pair is a single number once a task has counted
it; contexts with many tokens are spread over parts by what follows. Results
are sorted arrays in the shared folder, and dense tables by number. Workers map
them and look up sorted queries; the page cache, not a heap, holds what is used.

What is gathered grows with the corpus; nothing of it passes the driver but a
few totals a part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .runtime import arrow_map, shared_path, small_batches, spare, tidy_shuffles
from .tokens import Piece, mix64, pieces

#: The token that ends every text; no word has this hash but by chance of 2 ** -64.
END = np.uint64(0xE17A1465B0C4D1B9)
#: Tokens or pairs that a task counts before it sends what it has.
BUFFER = 4_000_000
#: Tokens that are looked up at once, or those of one longer piece.
GROUP = 300_000
#: Contexts with more than this share of a part's tokens are spread over SPREAD parts.
SPREAD = 64
#: Parts are twice the input's partitions, up to this power of two: a task sends a table to each.
MAX_PART_BITS = 14


def tokens_of(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of every text with END after each, and each text's first (their number last)."""
    h = piece.hashes()
    n = piece.n_texts
    first = piece.first + np.arange(n + 1)
    out = np.full(len(h) + n, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = h
    return out, first


def _groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, tokens and first tokens of some whole texts: the more are looked up at once, the nearer their places lie."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def joined() -> tuple[int, np.ndarray, np.ndarray]:
        begin = np.cumsum([0, *(len(t) for _, t, _ in held)])
        return held[0][0], np.concatenate([t for _, t, _ in held]), np.concatenate([*(f[:-1] + b for (_, _, f), b in zip(held, begin[:-1], strict=True)), begin[-1:]])

    for piece in pieces(column):
        held.append((piece.rows.start, *tokens_of(piece)))
        if sum(len(t) for _, t, _ in held) > GROUP:
            yield joined()
            held.clear()
    if held:
        yield joined()


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2, and 3 or more, from how many keys have each count from 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, each key's place among them, and how many there are of each."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]])
    first = np.flatnonzero(new)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return own[first], order[first], back, np.diff(first, append=len(keys))


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part that keeps the order within each, and where each part begins; small numbers sort by their digits."""
    part = part.astype(np.uint16)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def count_classes(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class KneserNey:
    """Where the arrays are, and the totals that scoring needs. Levels count from 1, the words."""

    folder: str
    parts: int
    order: int
    first: dict[int, np.ndarray] = field(default_factory=dict)  # by level: number of the first gram of each part, their number last
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    n_tokens: int = 0
    n_texts: int = 0  # how often a text's start was a context
    n_pairs: int = 0
    word_classes: tuple[int, int, int] = (0, 0, 0)
    present: frozenset[str] = frozenset()  # tables that training wrote; a part without keys has none

    @property
    def n_words(self) -> int:
        return int(self.first[1][-1])

    def part_of_hash(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - int(self.parts).bit_length() + 1)).astype(np.int64) if self.parts > 1 else np.zeros(len(h), np.int64)

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (from 1; 0 if unknown) and training count of each sorted distinct hash."""
        return self._found(1, h, self.part_of_hash(h))

    def part_of_gram(self, key: np.ndarray, context_count: np.ndarray) -> np.ndarray:
        hot = context_count * self.parts * 2 > self.n_tokens
        spread = np.where(hot, key & np.uint64(SPREAD - 1), np.uint64(0))
        with np.errstate(over="ignore"):
            return (mix64((key >> np.uint64(32)) * np.uint64(SPREAD) + spread) % np.uint64(self.parts)).astype(np.int64)

    def _found(self, level: int, keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        order, edges = _by_part(part, self.parts)
        for p in np.flatnonzero(np.diff(edges)):
            if f"grams{level}-{p}" in self.present:
                own = order[edges[p] : edges[p + 1]]
                known = store.mapped(self.folder, f"grams{level}-{p}", "<u8")
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                good = known[at] == keys[own]
                numbers[own] = np.where(good, at + self.first[level][p] + 1, 0)
                counts[own] = np.where(good, store.mapped_counts(self.folder, f"counts{level}-{p}", len(known))[at][:, 0], 0)
        return numbers, counts

    def longer(self, level: int, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From each token's gram a level below: number and count of its gram, its context's number, and whether it has a context."""
        key, context_count, has = _keys(level, ids, counts, first, self.n_texts)
        kinds, at, back, _ = _distinct(key[has])
        found = self._found(level, kinds, self.part_of_gram(kinds, context_count[has][at]))
        numbers, times = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        numbers[has], times[has] = found[0][back], found[1][back]
        return numbers, times, (key >> np.uint64(32)).astype(np.int64), has

    def low(self, level: int, part: int) -> int:
        """The least number in a part's dense tables; 0, in the first, stands for a text's start or what is unknown."""
        return 0 if part == 0 else int(self.first[level][part]) + 1

    def size(self, level: int, part: int) -> int:
        return int(self.first[level][part + 1]) + 1 - self.low(level, part)

    def part_of_number(self, level: int, ids: np.ndarray) -> np.ndarray:
        # Number 0 is in part 0, which may have no grams.
        return np.where(ids > 0, np.searchsorted(self.first[level][1:], np.maximum(ids.astype(np.int64) - 1, 0), "right"), 0)

    def by_number(self, name: str, level: int, ids: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of a dense table for numbers of a level."""
        kinds, _, back, _ = _distinct(ids)
        out = np.zeros((len(kinds), width), np.int64)
        edges = np.searchsorted(kinds, np.concatenate([[0], self.first[level][1:] + 1]))
        for p in np.flatnonzero(np.diff(edges)):
            if f"{name}-{p}" in self.present:
                table = store.mapped_counts(self.folder, f"{name}-{p}", self.size(level, p), width)
                out[edges[p] : edges[p + 1]] = table[kinds[edges[p] : edges[p + 1]] - self.low(level, p)]
        return out.take(back, axis=0)


def _numbered(tokens: np.ndarray, model: KneserNey) -> tuple[np.ndarray, np.ndarray]:
    kinds, _, back, _ = _distinct(tokens)
    ids, counts = model.ids(kinds)
    return ids[back], counts[back]


def _keys(level: int, ids: np.ndarray, counts: np.ndarray, first: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key of each token's gram, its context's count, and whether it has a known context; of pairs, a text's start is context 0."""
    context = np.concatenate([[0], ids[:-1]])
    count = np.concatenate([[0], counts[:-1]])
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    has = (context > 0) & (place >= max(1, level - 2))
    if level == 2:
        context[first[:-1]], count[first[:-1]], has[first[:-1]] = 0, n_texts, True
    return (context.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), count, has


def _sent(keys: np.ndarray, part: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """One packed table a part, of sorted keys."""
    order, edges = _by_part(part, int(part.max()) + 1 if len(part) else 0)
    parts = np.flatnonzero(np.diff(edges))
    blobs = [store.pack(keys[o], *(v[o] for v in values)) for o in (order[edges[p] : edges[p + 1]] for p in parts)]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "packed"])


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(part, summed table) from rows sorted by part."""
    now, held = None, []
    for batch in batches:
        for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != now:
                if held:
                    yield now, store.summed(held)
                now, held = part, []
            held.append(store.unpack(packed.as_py()))
            if sum(len(h[0]) for h in held) > BUFFER and len(held) > 8:
                held = [store.summed(held)]
    if held:
        yield now, store.summed(held)


def _counter(parts_of, keys_of):
    """Counts keys over the texts of a task; sends tables of BUFFER keys or less."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, counts, *rest = store.summed(held)
                yield _sent(keys, parts_of(keys, *rest), counts)
                held.clear()

        for batch in batches:
            for _, tokens, first in _groups(batch.column(0)):
                table = keys_of(tokens, first)
                held.append(table)
                n += len(table[0])
                if n > BUFFER:
                    yield from flush()
                    n = 0
        yield from flush()

    return run


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("part").sortWithinPartitions("part")


#: Rows between the steps of training: a packed table for a part, or totals of a table that a task wrote (part -1).
HELD = "part int, packed binary, classes array<long>, n long"
#: What such totals are of: a part of a level's grams, how many words come before its grams, sums by its contexts.
GRAMS, FOLLOWED, CONTEXTS = 0, 1, 2
#: The sums by a context: all counts, and how many are 1, 2, and 3 or more.
SUMS = 4


def _tables(sent: pa.RecordBatch, add: int) -> pa.RecordBatch:
    n = len(sent)
    return pa.RecordBatch.from_arrays([pa.array(sent.column(0).to_numpy() + add, pa.int32()), sent.column(1), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=["part", "packed", "classes", "n"])


def _totals(rows: list[tuple[list[int], int]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), pa.array([b""] * n, pa.binary()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int64())], names=["part", "packed", "classes", "n"])


def _summed_by(ids: np.ndarray, values: list[np.ndarray], part_of, add: int) -> pa.RecordBatch:
    """Sums of values by number, a packed table for each part of the numbers."""
    order = np.argsort(ids)
    own, first = np.unique(ids[order], return_index=True)
    return _tables(_sent(own, part_of(own), *(np.add.reduceat(v[order].astype(np.uint64), first) for v in values)), add)


def _by_context(keys: np.ndarray, counts: np.ndarray, part_of) -> pa.RecordBatch:
    return _summed_by(keys >> np.uint64(32), [counts, counts == 1, counts == 2, counts >= 3], part_of, 0)


def _count_grams(texts: DataFrame, model: KneserNey, level: int) -> DataFrame:
    """Writes a level's grams and counts; rows for ``_save_sums`` of the level below."""

    def grams(tokens: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        ids, counts = _numbered(tokens, model)
        for low in range(2, level):
            ids, counts, _, _ = model.longer(low, ids, counts, first)
        key, context_count, has = _keys(level, ids, counts, first, model.n_texts)
        kinds, at, _, n = _distinct(key[has])
        return [kinds, n.astype(np.uint64), context_count[has][at].astype(np.uint64) * n.astype(np.uint64), n.astype(np.uint64)]

    # Values sum up, so the context's count comes as a weighted sum beside its weight.
    part_of = lambda k, weighted, weight: model.part_of_gram(k, (weighted // weight).astype(np.int64))

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_below = lambda ids: model.part_of_number(level - 1, ids)
        for part, (keys, counts) in _gathered(batches):
            store.put(model.folder, f"grams{level}-{part}", keys.astype("<u8"))
            store.put_counts(model.folder, f"counts{level}-{part}", counts)
            if level == model.order:
                yield _by_context(keys, counts, part_below)
            yield _summed_by(keys & np.uint64((1 << 32) - 1), [np.ones(len(keys), np.uint64)], part_below, model.parts)
            yield _totals([([level, GRAMS, part, *count_classes(counts), 0], len(keys))])

    return arrow_map(_dealt(arrow_map(texts, _counter(part_of, grams), "part int, packed binary")), save, HELD)


def _save_sums(rows: DataFrame, model: KneserNey, level: int) -> DataFrame:
    """Writes dense tables by a level's numbers. Where these are grams, what comes before each is summed by context for the level below."""

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def tables() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy() < 0
                if own.any():
                    kept = batch.filter(pa.array(own))
                    out.extend(zip(kept.column(2).to_pylist(), kept.column(3).to_pylist(), strict=True))
                yield batch.filter(pa.array(~own))

        for part, (ids, *values) in _gathered(tables()):
            kind, q = divmod(part, model.parts)
            at = ids.astype(np.int64) - model.low(level, q)
            dense = [np.zeros(model.size(level, q), np.uint64) for _ in values]
            for d, v in zip(dense, values, strict=True):
                d[at] = v
            if kind == 0:
                store.put_counts(model.folder, f"context{level + 1}-{q}", np.stack(dense, axis=1))
                out.append(([level + 1, CONTEXTS, q, 0, 0, 0, 0, 0], 0))
                continue
            (before,) = dense
            if level > 1:
                # Before a gram that opens a text comes nothing else: it keeps its count.
                keys = store.mapped(model.folder, f"grams{level}-{q}", "<u8")
                own = before[len(before) - len(keys) :]
                own[:] = np.where(own > 0, own, store.mapped_counts(model.folder, f"counts{level}-{q}", len(keys))[np.arange(len(keys))][:, 0])
                yield _by_context(keys, own, lambda i: model.part_of_number(level - 1, i))
            store.put_counts(model.folder, f"followed{level}-{q}", before)
            out.append(([level, FOLLOWED, q, *count_classes(before), int((before >= 3).sum())], int(before.sum())))
        if out:
            yield _totals(out)

    return arrow_map(_dealt(rows), save, HELD)


def train(docs: DataFrame, order: int = 2) -> KneserNey:
    """Counts a model of ``order`` 2 or more over all rows of ``docs`` (text; null is empty). An empty table gives a model of no words.

    Levels below the highest may have up to 2 ** 32 distinct grams; beyond, an
    error says so.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    folder = shared_path(spark, "lm")
    parts = 1 << min(MAX_PART_BITS, max(2, (2 * texts.rdd.getNumPartitions() - 1).bit_length()))
    model = KneserNey(folder, parts, order)

    def words(tokens: np.ndarray, _: np.ndarray) -> list[np.ndarray]:
        kinds, n = np.unique(tokens, return_counts=True)
        return [kinds, n.astype(np.uint64)]

    def save_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (keys, counts) in _gathered(batches):
            store.put(folder, f"grams1-{part}", keys.astype("<u8"))
            store.put_counts(folder, f"counts1-{part}", counts)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [len(keys)], "total": [int(counts.sum())], "texts": [int(counts[keys == END].sum())]})

    def numbered(level: int, sizes: Iterable[tuple[int, int]]) -> None:
        n = np.zeros(parts, np.int64)
        for part, size in sizes:  # a row for each part
            n[part] = size
        model.first[level] = np.concatenate([[0], np.cumsum(n)])
        model.present |= {f"grams{level}-{p}" for p in np.flatnonzero(n)}
        if level < order and model.first[level][-1] >= 1 << 32:
            raise ValueError(f"more than 2 ** 32 distinct grams of {level} words")

    part_of_word = lambda k: model.part_of_hash(k)
    with tidy_shuffles(spark):
        counted = arrow_map(_dealt(arrow_map(texts, _counter(part_of_word, words), "part int, packed binary")), save_words, "part int, n long, total long, texts long").collect()
    numbered(1, ((r["part"], r["n"]) for r in counted))
    model.n_tokens = sum(r["total"] for r in counted)
    model.n_texts = sum(r["texts"] for r in counted)

    nothing = store.pack(np.empty(0, np.uint64), np.empty(0, np.uint64))
    with tidy_shuffles(spark):
        for level in range(2, order + 1):
            rows = _count_grams(texts, model, level)
            if level > 2:
                # Grams that all open texts have nothing before them: their parts come up all the same.
                known = [(parts + p, nothing, None, None) for p in range(parts) if f"grams{level - 1}-{p}" in model.present]
                rows = _save_sums(rows.union(spark.createDataFrame(known, HELD)) if known else rows, model, level - 1)
            totals = [(*r["classes"], r["n"]) for r in _save_sums(rows, model, level - 1 if level == 2 else level - 2).collect()]
            classes: dict[tuple[int, int], np.ndarray] = {}
            for own, kind, part, *counts, _ in totals:
                classes[own, kind] = classes.get((own, kind), 0) + np.array(counts)
                model.present |= {FOLLOWED: {f"followed{own}-{part}"}, CONTEXTS: {f"context{own}-{part}"}}.get(kind, set())
            numbered(level, ((t[2], t[-1]) for t in totals if t[:2] == (level, GRAMS)))
            of_below = classes.get((level - 1, FOLLOWED), np.zeros(5, np.int64))
            model.discounts[level - 1] = discounts(of_below[:4])
            if level == 2:
                model.n_pairs = sum(t[-1] for t in totals if t[:2] == (1, FOLLOWED))
                model.word_classes = (int(of_below[0]), int(of_below[1]), int(of_below[4]))
            if level == order:
                model.discounts[level] = discounts(classes.get((level, GRAMS), np.zeros(5, np.int64))[:4])
    return model


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(counts - d[np.minimum(counts, 3)], 0.0)


def probabilities(model: KneserNey, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of every token, given those before it in its text."""
    floor = np.dot(model.discounts[1][1:], model.word_classes) / model.n_pairs if model.n_pairs else 1.0
    followed = np.where(ids > 0, model.by_number("followed1", 1, ids)[:, 0], 0)
    p = _discounted(followed, model.discounts[1]) / max(1, model.n_pairs) + floor / (model.n_words + 1)
    for level in range(2, model.order + 1 if model.n_pairs else 2):
        ids, counts, context, has = model.longer(level, ids, counts, first)
        total, one, two, more = np.where(has[:, None], model.by_number(f"context{level}", level - 1, context, SUMS), 0).T
        times = counts if level == model.order else np.where(ids > 0, model.by_number(f"followed{level}", level, ids)[:, 0], 0)
        d = model.discounts[level]
        n = np.maximum(total, 1)
        back = np.where(total > 0, (d[1] * one + d[2] * two + d[3] * more) / n, 1.0)
        p = np.where(total > 0, _discounted(times, d) / n, 0.0) + back * p
    return np.log10(p)


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score of each whole ``text``.

    A text's tokens are its words (ASCII white space splits, A-Z lower-cased)
    and one end. n_known: tokens that training has; base_score: their log10
    probability by add-one counts of single tokens; score: by the model. Null
    and empty texts have one token, the end. Other columns stay; added ones get
    underscores in front if a name is taken.
    """
    at = [c.lower() for c in docs.columns].index("text")
    names = [spare(docs, c) for c in ("n_tokens", "n_known", "base_score", "score")]
    n, v = model.n_tokens, model.n_words
    schema = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(0).cast("long"), names[2]: F.lit(0.0), names[3]: F.lit(0.0)}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, tokens, first in _groups(batch.column(at)):
                ids, counts = _numbered(tokens, model)
                base = np.log10((counts + 1) / (n + v + 1))
                logs = probabilities(model, ids, counts, first)
                part = batch.slice(row, len(first) - 1)
                sums = [np.diff(first), np.add.reduceat((counts > 0).astype(np.int64), first[:-1]), np.add.reduceat(base, first[:-1]), np.add.reduceat(logs, first[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(s) for s in sums)], names=schema.names)

    return arrow_map(docs, run, schema)


def held_out(doc_id: Column, of: int = 7, which: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == which, F.lit(False))
