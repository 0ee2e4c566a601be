"""The Jaccard join, line dedup and decontamination against brute force."""

from __future__ import annotations

import random

import helpers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetlens.llm import components, counttree, decontaminate, jaccard, linededup, tokens

DOC = "doc_id long, text string"


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components(docs, corpus, k, percent) -> None:
    found = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.similar(docs, k, percent).collect()}
    wanted = helpers.components(corpus, k, percent)
    assert found == {i: (wanted[i], len(helpers.shingles(t, k))) for i, t in corpus.items()}


def test_blocks_in_pieces(docs, corpus, monkeypatch) -> None:
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "SAMPLE", 1_000_000)  # no element counts as frequent beyond the limit below
    monkeypatch.setattr(jaccard, "HEAVY", 1)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar(docs).collect()}
    assert found == helpers.components(corpus, 4, 85)


def test_jaccard_edges(spark) -> None:
    empty = spark.createDataFrame([], DOC)
    assert jaccard.similar(empty).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (2, "q r s t u v")]
    found = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.similar(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert found == sorted([(1, 1, 2), (1, 1, 2), (None, None, 2), (2, 1, 2), (2, 2, 3)], key=str)


def test_long_chain_is_one_component(spark) -> None:
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(5, 5), (1001, 1000)], "a long, b long")
    found = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components.components(edges.limit(0)).count() == 0


def test_tree_finds_what_bounds_allow() -> None:
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[3:], s[:1]])) for s in sets[:80] if len(s) > 4]
    vectors, sizes = [counttree.count_vector(s) for s in sets], np.array([len(s) for s in sets])
    q, p = counttree.CountTree(vectors, sizes).search(vectors, sizes, 85)
    found = set(zip(q.tolist(), p.tolist(), strict=True))
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 185 * both >= 85 * (sizes[a] + sizes[b]):
                assert (a, b) in found
    assert len(found) < 0.2 * len(sets) ** 2


def test_leaks(docs, corpus, spark) -> None:
    r = random.Random(2)
    items: dict[int, str | None] = {1: " ".join(corpus[15].split()[:30]), 2: "w1 w2 w3", 3: "", 4: None, 5: corpus[64], 6: "ONE"}
    texts = dict(corpus)
    for d in range(200, 230):
        w = items[r.choice([1, 5])].split()
        w[r.randrange(len(w))] = "changed"
        texts[d] = " ".join([r.choice(["x", "y", "z"]) for _ in range(r.randrange(40))] + w + ["end"] * r.randrange(9))
    frame = spark.createDataFrame(list(texts.items()), DOC)
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items.items()] + [(2, "w1 w2 w3", "again")], "item_id long, text string, doc_id string")
    found = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(frame, bench).collect()}
    wanted = helpers.leaks({d: t for d, t in texts.items() if d not in (120, 121)}, items)
    assert {k: v for k, v in found.items() if k[0] not in (120, 121)} == pytest.approx(wanted)
    kept = {x["doc_id"] for x in decontaminate.without_leaks(frame, bench).collect()}
    assert kept == set(texts) - {d for d, _ in found}


def test_leaks_in_several_passes(spark, corpus, monkeypatch) -> None:
    frame = spark.createDataFrame([(i, t) for i, t in corpus.items() if i < 60], DOC)
    bench = spark.createDataFrame([(i, corpus[i]) for i in range(10, 30)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(frame, bench).collect()))
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", 500)
    assert sorted(map(tuple, decontaminate.leaks(frame, bench).collect())) == whole and whole


def test_leaks_in_very_long_texts(spark) -> None:
    """A text that repeats one shingle of an item everywhere, and holds the item once, far in."""
    item = "a b c d e f g h i j"
    text = "a b c d e " * 40_000 + item + " z" * 100_000
    frame = spark.createDataFrame([(1, text), (2, "a b c d e " * 40_000)], DOC)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.leaks(frame, bench).collect()] == [(1, 7, 1.0, 200_000)]


def test_leaks_with_every_window(corpus) -> None:
    items = [(1, " ".join(corpus[15].split()[:30])), (2, "w1 w2 w3"), (5, corpus[64]), (6, "ONE")]
    index = decontaminate.BenchmarkIndex.build(items)
    texts = [t for i, t in corpus.items() if i < 100]
    found = [[(p.rows.start + t, *x) for p in tokens.pieces(pa.array(texts)) for t, *x in index.matches(p, 0.8, every)] for every in (False, True)]
    assert found[0] == found[1] and found[0]


def test_leak_edges(spark) -> None:
    some = spark.createDataFrame([(1, "a b c d e f g")], DOC)
    items = spark.createDataFrame([(1, "b c d e f")], "item_id long, text string")
    assert decontaminate.leaks(some.limit(0), items).count() == 0
    assert decontaminate.leaks(some, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(some, items.limit(0)).count() == 1
    assert [tuple(r) for r in decontaminate.leaks(some, items).collect()] == [(1, 1, 1.0, 1)]


def test_line_dedup(spark) -> None:
    r = random.Random(4)
    lines = [f"line {i}" for i in range(12)] + ["", "  ", "same", "same"]
    texts = [(d, "\n".join(r.choice(lines) for _ in range(r.randrange(30)))) for d in range(-5, 60)] + [(100, None), (101, ""), (102, "a\nb\nc"), (103, "x\na \nb\n c\ny"), (104, "\n".join(["big"] * 5000))]
    frame = spark.createDataFrame([(d, t, 3, "k") for d, t in texts], "doc_id long, text string, n_lines int, digest string")
    out = linededup.dedup_lines(frame)
    assert out.columns == ["doc_id", "text", "n_lines", "digest", "_n_lines", "n_removed"]
    assert {r_["doc_id"]: r_["text"] for r_ in out.collect()} == helpers.dedup_lines(texts)


def test_line_dedup_edges(spark) -> None:
    schema = "doc_id long, text string"
    assert linededup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    rows = [(2, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb\nc\nd"), (3, "a\nb\nc\ne")]
    found = sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, schema)).collect())
    # The row without a doc_id comes first; equal rows get equal results.
    assert found == [("2", "", 3), ("2", "", 3), ("3", "e", 3), ("None", "a\nb\nc\nd", 0)]


def test_line_dedup_is_native(spark, docs) -> None:
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert docs.select(F.lit(1)).count() > 0
