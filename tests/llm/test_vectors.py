"""Hard negatives and near-duplicate vectors against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.llm import components, neardup, negatives

ROWS = "vec_id long, embedding array<double>, label int"


def mined(rows: list[tuple], positives: int = 5, k: int = 5) -> set[tuple]:
    """Brute force over (vec_id, embedding, label); anchors are divisible by 10."""
    valid = [(i, tuple(math.floor(256 * x) for x in v), y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    valid = list(dict.fromkeys(valid))
    out = set()
    for anchor, a, own in valid:
        if anchor % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i, y) for i, v, y in valid if len(v) == len(a))
        for minus, positive, _ in [x for x in scored if x[2] == own and x[1] != anchor][:positives]:
            hard = [x for x in scored if x[2] != own and 80 * -minus <= 100 * -x[0] <= 100 * -minus][:k]
            out |= {(anchor, positive, rank, i, -minus, -s) for rank, (s, i, _) in enumerate(hard, 1)}
    return out


def found(frame, **more) -> set[tuple]:
    out = negatives.mine(frame, F.col("vec_id") % 10 == 0, F.col("label"), **more).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert len(out) == len({tuple(r[c] for c in names) for r in out})
    return {tuple(r[c] for c in names) for r in out}


@pytest.fixture(scope="module")
def labelled() -> list[tuple]:
    """Few directions, so that scores tie and ranges are full; a hot label, copies, and rows that take no part."""
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows: list[tuple] = []
    for i in range(260):
        near = r.choice(centres)
        rows.append((i, [x + r.choice([0, 0, 0.1, r.gauss(0, 0.4)]) for x in near], r.choice([1, 1, 1, 2, 3])))
    rows += [(300, rows[10][1], 1), (301, rows[10][1], 2), (7, rows[7][1], rows[7][2]), (10, rows[11][1], 2)]
    rows += [(310, None, 1), (320, [0.5] * 12, None), (None, [0.5] * 12, 1), (330, [math.nan] * 12, 1), (340, [math.inf] + [0.0] * 11, 1), (350, [None] + [0.1] * 11, 1)]
    rows += [(360, [0.0] * 12, 1), (370, [1.0, 2.0], 1), (371, [1.0, 2.0], 1), (372, [1.0, 1.9], 2), (380, [], 1), (381, [], 2)]
    return rows


@pytest.mark.parametrize("block", [30, 8192])
def test_hard_negatives(spark, labelled, monkeypatch, block) -> None:
    for name, value in (("BLOCK", block), ("ANCHORS", block // 6), ("TILE", block)):
        monkeypatch.setattr(negatives, name, value)
    frame = spark.createDataFrame([(*x, 1, 2, b"k") for x in labelled], ROWS + ", dim int, block int, key binary")
    assert found(frame.repartition(5)) == mined(labelled) != set()


def test_hard_negatives_take_parameters(spark, labelled) -> None:
    assert found(spark.createDataFrame(labelled, ROWS), positives=2, negatives=3) == mined(labelled, 2, 3)


def test_hard_negative_edges(spark) -> None:
    assert found(spark.createDataFrame([], ROWS)) == set()
    assert found(spark.createDataFrame([(10, [1.0], 1)], ROWS)) == set()
    assert found(spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)], ROWS)) == {(10, 11, 1, 12, 65536, 256 * 230)}
    with pytest.raises(Exception, match="64 bits"):
        found(spark.createDataFrame([(10, [1e30], 1)], ROWS))


def test_planes_drop_early_and_lose_nothing() -> None:
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 32))
    v = np.floor(256 * v / np.sqrt((v * v).sum(1))[:, None]).astype(np.int64)
    anchors, planes = v[:50], negatives.Planes(v)
    whole = anchors @ v.T
    floor, ceiling = np.sort(whole, axis=1)[:, -40], np.sort(whole, axis=1)[:, -10]
    a, x, score, work = negatives.scores(anchors, planes, slice(0, 3000), np.ones(whole.shape, bool), floor, ceiling)
    wanted = np.nonzero((whole >= floor[:, None]) & (whole <= ceiling[:, None]))
    assert set(zip(a.tolist(), x.tolist(), score.tolist(), strict=True)) == set(zip(*(w.tolist() for w in wanted), whole[wanted].tolist(), strict=True))
    assert work < 0.8 * whole.size * len(planes.places)


VECTORS = "vec_id long, embedding array<double>"


def united(rows: list[tuple], least: float) -> list[tuple]:
    """Brute force over (vec_id, embedding): vec_id, n_links, component_id, kept of each row."""
    unit = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        most = max(map(abs, v)) if good else 1
        length = math.sqrt(sum((x / most) ** 2 for x in v)) if good else 1
        unit.append([x / most / length for x in v] if good else None)
    linked = [[j for j, b in enumerate(unit) if j != i and a and b and len(a) == len(b) and np.dot(a, b) >= least] for i, a in enumerate(unit)]
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in linked[todo.pop()] if j not in seen])
            seen |= set(new)
        least_id = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(linked[i]), least_id, vec_id is None or vec_id == least_id))
    return sorted(out, key=str)


def told(frame, least: float = 0.95) -> list[tuple]:
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame, least).collect()), key=str)


@pytest.fixture(scope="module")
def clouds() -> list[tuple]:
    """Tight and loose groups, chains whose ends don't link, pairs near the threshold, exact copies, and single vectors."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.sqrt((x * x).sum())
    rows = [unit(rng.normal(size=24)) for _ in range(120)]
    for n, noise in ((90, 0.03), (60, 0.06), (40, 0.075)):
        centre = unit(rng.normal(size=24))
        rows += [unit(centre + noise * rng.normal(size=24)) for _ in range(n)]
    x = unit(rng.normal(size=24))
    for _ in range(30):
        rows.append(x)
        x = unit(x + 0.045 * rng.normal(size=24))
    for cosine in (0.9501, 0.9499, 0.95001, 0.94999):
        a, e = unit(rng.normal(size=24)), rng.normal(size=24)
        e = unit(e - (e @ a) * a)
        rows += [a, cosine * a + math.sqrt(1 - cosine * cosine) * e]
    rows += [rows[5]] * 7 + [rows[130]] * 5 + [rows[7] * 1e-200, rows[8] * 1e200, -rows[9]]
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_near_duplicates(spark, clouds) -> None:
    odd = [(None, clouds[0][1]), (900, None), (901, []), (902, [0.0] * 24), (903, [math.nan] * 24), (904, [None] * 24), (905, [math.inf] * 24), (906, [1.0, 0.0]), (907, [1.0, 0.01])]
    rows = clouds + odd + clouds[130:134] + [(clouds[140][0], clouds[3][1])]
    frame = spark.createDataFrame([(*x, 1, 2, b"u") for x in rows], VECTORS + ", n int, node int, u binary")
    assert told(frame.repartition(6)) == united(rows, 0.95)


def test_large_components_in_shells(spark, clouds, monkeypatch) -> None:
    """Components beyond a block give the same counts; of a tight group no pair is compared."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert told(spark.createDataFrame(clouds, VECTORS)) == united(clouds, 0.95)
    assert told(spark.createDataFrame(clouds, VECTORS), 0.8) == united(clouds, 0.8)


def test_near_duplicate_edges(spark) -> None:
    assert told(spark.createDataFrame([], VECTORS)) == []
    assert told(spark.createDataFrame([(4, None), (None, None)], VECTORS)) == [(4, 0, 4, True), (None, 0, None, True)]
    assert told(spark.createDataFrame([(4, [2.0]), (3, [5.0]), (5, [-1.0])], VECTORS)) == [(3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]
    copies = spark.range(3000).selectExpr("id AS vec_id", "array(0.5D, 0.25D) AS embedding")
    assert {tuple(r)[1:] for r in neardup.near_duplicates(copies).collect()} == {(2999, 0, False), (2999, 0, True)}


def test_borders_of_partitions_lose_nothing(spark, clouds) -> None:
    """Links don't depend on how the orders are cut, as long as partitions hold a window."""
    nodes = [(i, np.array(v, "<f8").tobytes()) for i, v in clouds if math.isclose(sum(x * x for x in v), 1, rel_tol=1e-9)]
    frame = spark.createDataFrame(nodes, "node long, u binary")
    cut = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = neardup.links(frame, 24, len(nodes), 0.95)
        cut.append(sorted(map(tuple, components.components(edges).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut[0] == cut[1] != []


def test_passes_grow_slowly() -> None:
    assert neardup.orders(10, 0.95)[0] == neardup.PASSES
    few, many = neardup.orders(50_000, 0.95)[0], neardup.orders(10**9, 0.95)[0]
    assert 10 < few < 30 and many < 8 * few
    a, b = neardup.least_of_groups(np.array([5, 4, 9, 9]), np.array([4, 3, 9, 8]))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(5, 3), (4, 3), (9, 8)}
