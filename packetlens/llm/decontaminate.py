"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item of L words is compared with every window of L words of a document that
could be similar to it: a similar window shares a shingle with the item, so
windows that share none are left out unless ``every_window`` asks for them, and
the others are fingerprinted. Fingerprints of 128 bits are
looked up in 16 tables, one for each byte: of two fingerprints at most
``RADIUS`` bits apart, some byte differs in at most ``RADIUS // 16`` bits, so
the tables find every item within the radius. What they find is verified by the
weighted Jaccard similarity of the shingle multisets.

At similarity 0.8 the expected distance is 19 bits, its deviation 4; the radius
of 44 lies six deviations above.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, small_batches
from .tokens import Piece, gram_hash, grams, mix64, pieces

SHINGLE = 5
BITS = 128
BLOCKS = BITS // 8
RADIUS = 44
#: Windows that are fingerprinted at once.
WINDOWS = 8192
#: Characters of benchmark text in one index; a larger benchmark is searched in several passes.
INDEX_CHARS = 20_000_000
_OTHER = np.uint64(0xA0761D6478BD642F)
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of each shingle."""
    both = np.stack([shingles, mix64(shingles ^ _OTHER)], axis=1).view(np.uint8)
    return np.unpackbits(both, axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


@dataclass
class BenchmarkIndex:
    """Items with their shingles, fingerprints and byte tables."""

    ids: np.ndarray
    length: np.ndarray
    shingles: list[np.ndarray]
    counts: list[np.ndarray]
    prints: np.ndarray
    tables: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> BenchmarkIndex:
        items = sorted({(i, t) for i, t in items if t and i is not None})
        ids, length, shingles, counts, prints = [], [], [], [], []
        seeds: dict[int, list] = defaultdict(list)
        for piece in pieces(pa.array([t for _, t in items], pa.string())):
            h = piece.hashes()
            for j in range(piece.n_texts):
                words = h[piece.first[j] : piece.first[j + 1]]
                if not len(words):
                    continue
                k = min(SHINGLE, len(words))
                own = gram_hash([words[x : len(words) - k + 1 + x] for x in range(k)])
                kinds, times = np.unique(own, return_counts=True)
                seeds[k] += [(x, len(ids)) for x in kinds]
                ids.append(items[piece.rows.start + j][0])
                length.append(len(words))
                shingles.append(kinds)
                counts.append(times)
                prints.append(fingerprints(signs(own).sum(0)[None])[0])
        n = len(ids)
        prints_ = np.stack(prints) if n else np.zeros((0, BLOCKS), np.uint8)
        near = _ONES[np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)] <= RADIUS // BLOCKS
        tables = np.stack([np.packbits(near[:, prints_[:, b]], axis=1) for b in range(BLOCKS)]) if n else np.zeros((BLOCKS, 256, 0), np.uint8)
        index = {}
        for k, pairs in seeds.items():
            pairs.sort()
            key = np.array([p[0] for p in pairs], np.uint64)
            kinds, first = np.unique(key, return_index=True)
            index[k] = (kinds, np.append(first, len(key)), np.array([p[1] for p in pairs]))
        return cls(np.array(ids, np.int64), np.array(length), shingles, counts, prints_, tables, index)

    def _near(self, piece: Piece, h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item length, places of shingles that it shares with items of that length, those items)."""
        for k, (kinds, first, owners) in self.seeds.items():
            g, text = grams(h, piece.first, k)
            if not len(g):
                continue
            at = np.minimum(np.searchsorted(kinds, g), len(kinds) - 1)
            n = np.maximum(np.diff(piece.first) - (k - 1), 0)
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            hits = np.flatnonzero(kinds[at] == g)
            if not len(hits):
                continue
            times = first[at[hits] + 1] - first[at[hits]]
            own = owners[np.repeat(first[at[hits]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))]
            hits = np.repeat(hits, times)
            order = np.lexsort((self.length[own], text[hits]))
            hits, own = hits[order], own[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(text[hits]) != 0) | (np.diff(self.length[own]) != 0)]))
            for a, b in zip(new, [*new[1:], len(hits)], strict=True):
                t = int(text[hits[a]])
                yield t, int(self.length[own[a]]), np.unique(hits[a:b] - begin[t]), np.unique(own[a:b])

    def _everywhere(self, piece: Piece) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """As ``_near``, with all places and all items."""
        for size in np.unique(self.length):
            k, items = min(SHINGLE, int(size)), np.flatnonzero(self.length == size)
            for t, n in enumerate(np.diff(piece.first)):
                if n >= k:
                    yield t, int(size), np.arange(n - k + 1), items

    def matches(self, piece: Piece, least: float, every_window: bool = False) -> Iterator[tuple[int, int, float, int]]:
        """(text, item_id, similarity, first word) of the best window for each text and item, where it reaches ``least``."""
        h = piece.hashes()
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for t, size, places, items in self._everywhere(piece) if every_window else self._near(piece, h):
            words = h[piece.first[t] : piece.first[t + 1]]
            for found, similarity, start in self._windows(words, size, places, items, least):
                if (t, found) not in best or (-similarity, start) < (-best[t, found][0], best[t, found][1]):
                    best[t, found] = (similarity, start)
        by_id: dict[tuple[int, int], tuple[float, int]] = {}
        for (t, item), (similarity, start) in best.items():
            key = (t, int(self.ids[item]))
            if key not in by_id or (-similarity, start) < (-by_id[key][0], by_id[key][1]):
                by_id[key] = (similarity, start)
        for (t, item_id), (similarity, start) in sorted(by_id.items()):
            yield t, item_id, similarity, start

    def _windows(self, words: np.ndarray, size: int, places: np.ndarray, items: np.ndarray, least: float) -> Iterator[tuple[int, float, int]]:
        """The windows that hold one of the shingles at ``places``, compared with ``items``, some thousands at a time."""
        k = min(SHINGLE, size)
        size = min(size, len(words))  # a shorter text is one window
        wide = size - k + 1
        edge = np.zeros(len(words) - size + 2, np.int64)
        np.add.at(edge, np.clip(places - wide + 1, 0, len(words) - size), 1)
        np.add.at(edge, np.clip(places, 0, len(words) - size) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        gaps = np.flatnonzero(np.diff(starts) > wide) + 1
        for a, b in zip([0, *gaps], [*gaps, len(starts)], strict=True):
            for c in range(a, b, WINDOWS):
                yield from self._compared(words, k, wide, starts[c : min(b, c + WINDOWS)], items, least)

    def _compared(self, words: np.ndarray, k: int, wide: int, starts: np.ndarray, items: np.ndarray, least: float) -> Iterator[tuple[int, float, int]]:
        low, high = int(starts[0]), int(starts[-1]) + wide
        own = gram_hash([words[low + x : high + x] for x in range(k)])
        run = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(own), axis=0, dtype=np.int32)])
        at = starts - low
        prints = fingerprints(run[at + wide] - run[at])
        mask = np.zeros((len(starts), self.tables.shape[2]), np.uint8)
        for b in range(BLOCKS):
            mask |= self.tables[b][prints[:, b]]
        for item in items.tolist():
            maybe = np.flatnonzero((mask[:, item >> 3] >> (7 - (item & 7))) & 1)
            maybe = maybe[_ONES[prints[maybe] ^ self.prints[item]].sum(1) <= RADIUS]
            if not len(maybe):
                continue
            kinds, times = self.shingles[item], self.counts[item]
            place = np.minimum(np.searchsorted(kinds, own), len(kinds) - 1)
            place = np.where(kinds[place] == own, place, len(kinds))
            for w in maybe:
                seen = np.bincount(place[at[w] : at[w] + wide], minlength=len(kinds) + 1)[:-1]
                both = int(np.minimum(seen, times).sum())
                similarity = both / (wide + int(times.sum()) - both)
                if similarity >= least:
                    yield item, similarity, int(starts[w])


def _indexes(benchmark: DataFrame) -> Iterator[BenchmarkIndex]:
    """The benchmark's items in indexes of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text") + 32)).first()[0] or 0
    passes = -(-chars // INDEX_CHARS)
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else items
        yield BenchmarkIndex.build([(r["item_id"], r["text"]) for r in part.collect()])


def leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.8, every_window: bool = False) -> DataFrame:
    """Pairs of a document and a benchmark item that one of its windows repeats.

    ``documents``: doc_id, text; ``benchmark``: item_id, text; other columns are
    ignored. Words are split at ASCII white space, A-Z lower-cased; shingles have
    five words, or all of an item with fewer. Returns doc_id, item_id,
    similarity, start (first word of the most similar window, the first of
    equals), for similarities of ``least`` or more. A document shorter than an
    item is one window. ``every_window`` fingerprints windows that share no
    shingle with an item too; as their similarity is 0, results are the same.

    Null and empty texts and items match nothing. Repeated items count once;
    items that share an item_id give their best window. Repeated documents give
    repeated rows. Empty tables give an empty result.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, start long"
    out = None
    for index in _indexes(benchmark):

        def run(batches: Iterable[pa.RecordBatch], index: BenchmarkIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch.column(1)):
                    found = list(index.matches(piece, least, every_window))
                    if found:
                        text, item, similarity, start = zip(*found, strict=True)
                        ids = batch.column(0).take(pa.array(np.array(text) + piece.rows.start))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.int64()), pa.array(similarity, pa.float64()), pa.array(start, pa.int64())], names=["doc_id", "item_id", "similarity", "start"])

        part = arrow_map(docs, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``documents``, all columns, none of whose windows repeats an item (see ``leaks``)."""
    small_batches(documents.sparkSession)
    at = [c.lower() for c in documents.columns].index("text")
    for index in _indexes(benchmark):

        def run(batches: Iterable[pa.RecordBatch], index: BenchmarkIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leak = np.zeros(batch.num_rows, bool)
                for piece in pieces(batch.column(at)):
                    leak[[piece.rows.start + m[0] for m in index.matches(piece, least)]] = True
                yield batch.filter(pa.array(~leak))

        documents = arrow_map(documents, run, documents.schema)
    return documents
