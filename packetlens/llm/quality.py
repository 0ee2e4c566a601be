"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 48 words. Each passage is encoded from its
own characters (how often one kind of character follows another, word shapes,
repetition), mapped to a hidden vector, and weighted by gated attention; the
document's score is a logistic function of the weighted sum. Encoder, attention
and scorer are learned together from document labels alone.

The fit takes a sample of labelled documents of bounded size (``max_fit``
documents, and of each ``max_passages`` passages at most, spread evenly over
it); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, small_batches, spare
from .tokens import Piece, grams, pieces

PASSAGE = 48
KINDS = 13
EXTRA = 8
WIDTH = KINDS * KINDS + EXTRA


def _kinds() -> np.ndarray:
    k = np.full(256, 10, np.int64)
    k[:32] = 12
    k[0x80:] = 11
    for kind, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".,", b"!?", b"'\"-", b"|/\\", b"#$%&*@^~")):
        k[list(chars)] = kind
    return k


_KIND = _kinds()


def encode(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a piece, and the index of each text's first passage (their number last)."""
    words = np.diff(piece.first)
    per_text = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per_text)])
    total = int(first[-1])
    text = piece.text_of
    place = np.arange(len(text)) - piece.first[:-1][text] if len(text) else np.empty(0, np.int64)
    word_passage = first[:-1][text] + place // PASSAGE if len(text) else np.empty(0, np.int64)
    out = np.zeros((total, WIDTH), np.float32)
    n = len(piece.data)
    if n:
        # A byte belongs to the passage of the last word that began; before any word, to the text's first.
        byte_text = np.repeat(np.arange(piece.n_texts), np.diff(piece.offsets))
        begun = np.zeros(n, np.int64)
        begun[piece.starts] = 1
        last = np.cumsum(begun) - 1
        own = last >= piece.first[:-1][byte_text]
        passage = np.where(own, word_passage[last] if len(word_passage) else 0, first[:-1][byte_text])
        kind = _KIND[piece.data]
        same = byte_text[1:] == byte_text[:-1]
        pair = (passage[:-1] * KINDS + kind[:-1]) * KINDS + kind[1:]
        counts = np.bincount(pair[same], minlength=total * KINDS * KINDS).reshape(total, -1)
        size = np.maximum(1, np.bincount(passage, minlength=total))
        out[:, : KINDS * KINDS] = np.sqrt(counts / size[:, None])
    if len(text):
        h = piece.hashes()
        lens = (piece.ends - piece.starts).astype(np.float64)
        n_words = np.maximum(1, np.bincount(word_passage, minlength=total))
        share = lambda mask: np.bincount(word_passage, weights=mask, minlength=total) / n_words
        first_kind, last_kind = _KIND[piece.data[piece.starts]], _KIND[piece.data[piece.ends - 1]]
        order = np.lexsort((h, word_passage))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (word_passage[order][1:] != word_passage[order][:-1])
        kinds_of = np.bincount(word_passage[order], weights=new, minlength=total) / n_words
        g, g_text = grams(h, piece.first, 3)
        again = np.zeros(total)
        if len(g):
            o = np.lexsort((g, g_text))
            repeat = np.zeros(len(g), bool)
            repeat[o[1:]] = (g[o][1:] == g[o][:-1]) & (g_text[o][1:] == g_text[o][:-1])
            starts = np.repeat(piece.first[:-1], np.maximum(words - 2, 0))
            at = np.arange(len(g)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(words - 2, 0))[:-1]]), np.maximum(words - 2, 0)) + starts
            again = np.bincount(word_passage[at], weights=repeat, minlength=total) / n_words
        out[:, KINDS * KINDS :] = np.stack(
            [share(lens) / 8, np.sqrt(share(lens * lens)) / 8, kinds_of, again, share(first_kind == 1), share((last_kind >= 6) & (last_kind <= 10)), share(first_kind >= 5), n_words / PASSAGE], axis=1
        )
    return out, first


@dataclass
class AttentionModel:
    """Weights: standardisation, hidden layer, gated attention, scorer."""

    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.w
        z = np.clip((x - w["mean"]) / w["scale"], -8, 8)
        h = np.tanh(z @ w["W"] + w["b"])
        a, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (a * g) @ w["q"]
        n = np.diff(first)
        bag = np.repeat(np.arange(len(n)), n)
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        att = e / np.add.reduceat(e, first[:-1])[bag]
        pooled = np.add.reduceat(h * att[:, None], first[:-1], axis=0)
        logit = pooled @ w["c"] + w["d"]
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40))), (z, h, a, g, att, pooled, bag)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        p, (z, h, a, g, att, pooled, bag) = self.forward(x, first)
        d = ((p - y) / len(y)).astype(np.float32)
        grad = {"c": pooled.T @ d, "d": np.array(d.sum())}
        d_pooled = d[:, None] * w["c"]
        d_att = (h * d_pooled[bag]).sum(1)
        inner = np.add.reduceat(d_att * att, first[:-1])
        d_e = att * (d_att - inner[bag])
        grad["q"] = (a * g).T @ d_e
        d_ag = d_e[:, None] * w["q"]
        d_a, d_g = d_ag * g * (1 - a * a), d_ag * a * g * (1 - g)
        grad["V"], grad["U"] = h.T @ d_a, h.T @ d_g
        d_h = (att[:, None] * d_pooled[bag] + d_a @ w["V"].T + d_g @ w["U"].T) * (1 - h * h)
        grad["W"], grad["b"] = z.T @ d_h, d_h.sum(0)
        return grad


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, decay: float = 1e-3, seed: int = 7) -> AttentionModel:
    """Learns a model from bags of passages and their labels, by Adam with weight decay."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"W": small(WIDTH, hidden), "b": np.zeros(hidden, np.float32), "V": small(hidden, gate), "U": small(hidden, gate), "q": small(gate), "c": small(hidden), "d": np.zeros((), np.float32)}
    everything = np.concatenate(bags) if bags else np.zeros((1, WIDTH), np.float32)
    w["mean"], w["scale"] = everything.mean(0), everything.std(0) + 1e-2
    model = AttentionModel(w)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the score is the labels' mean, or one half
        w["c"] = np.zeros(hidden, np.float32)
        w["d"] = np.float32(0.0 if not len(y) else (4.0 if y[0] else -4.0))
        return model
    m = {k: np.zeros_like(w[k]) for k in ("W", "b", "V", "U", "q", "c", "d")}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    t = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            ids = order[i : i + batch]
            x = np.concatenate([bags[j] for j in ids])
            first = np.concatenate([[0], np.cumsum([len(bags[j]) for j in ids])])
            t += 1
            for k, grad in model.gradients(x, first, y[ids]).items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + (decay * w[k] if k in ("W", "V", "U", "c") else 0))
    return model


def spread(first: int, last: int, most: int) -> np.ndarray:
    """At most ``most`` of the numbers from ``first`` up to ``last``, spread evenly, both ends included."""
    n = last - first
    return np.arange(first, last) if n <= most else first + np.arange(most) * (n - 1) // max(1, most - 1)


def _encoder(max_passages: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                x, first = encode(piece)
                rows = [x[spread(int(first[i]), int(first[i + 1]), max_passages)].tobytes() for i in range(piece.n_texts)]
                part = batch.slice(piece.rows.start, piece.n_texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "passages"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_fit: int = 4000, max_passages: int = 48) -> AttentionModel:
    """A model from the labelled rows of ``docs``.

    ``docs``: doc_id, text; ``labels``: doc_id, quality (0 or 1; null is no label; the mean decides among several). At most
    ``max_fit`` documents are taken, in the order of a hash of doc_id, and of each
    ``max_passages`` passages at most, so the driver holds 4000 * 48 passages of
    177 numbers, 136 MB, whatever the lengths of documents. Without labels every
    score is one half.
    """
    order = lambda df: df.orderBy(F.xxhash64(F.col("doc_id"), F.lit(9)), "doc_id").limit(max_fit)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    # The sample of labels has at most max_fit rows, so it is broadcast.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = arrow_map(text.join(F.broadcast(order(known)), "doc_id").select("doc_id", "label", "text"), _encoder(max_passages), "doc_id long, label int, passages binary")
    rows = sorted(order(sample).collect(), key=lambda r: (r["doc_id"], bytes(r["passages"])))
    bags = [np.frombuffer(r["passages"], np.float32).reshape(-1, WIDTH) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], np.float32))


def score(docs: DataFrame, model: AttentionModel, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole ``text``; higher means that label 1 is likelier.

    Null and empty texts are bags of one empty passage and get a score too.
    Equal texts get equal scores. Other columns stay; if ``column`` is taken,
    underscores are put before it.
    """
    name = spare(docs, column)
    small_batches(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty(batch.num_rows)
            for piece in pieces(batch.column(at)):
                x, first = encode(piece)
                found[piece.rows] = model.forward(x, first)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return arrow_map(docs, run, docs.withColumn(name, F.lit(0.0)).schema)
