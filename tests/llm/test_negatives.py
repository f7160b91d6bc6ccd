"""Hard negatives against scoring every pair, and the bounds against the exact scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    clean = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        clean.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for a, la, va in sorted({r[0]: r for r in sorted(clean, reverse=True)}.values()):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, k) for i, k, v in clean if i != a)
        for s, i in [(s, i) for s, i, k in scored if k == la][:5]:
            fit = [(t, j) for t, j, k in scored if k != la and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    vectors = df.where(negatives.usable(F.col("label"), F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))
    return sorted(map(tuple, negatives.mine(vectors, F.col("vec_id") % 100 == 0).collect()))


def made(n, seed, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    label = rng.integers(0, 4, n)
    x = (centres[label] * rng.uniform(0.1, 1, (n, 1)) + rng.normal(size=(n, width)) * 0.4).astype(np.float32)
    return [(int(k) * 10, v, int(c)) for k, (v, c) in enumerate(zip(x.tolist(), label))]


def test_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = made(700, 1)
    same = [0.5] * 12
    rows += [(k, same, 2) for k in range(20001, 20200)] + [(20300, same, 2), (20400, same, 1)]  # many copies of one vector, ties
    rows += [(None, same, 1), (31, None, 1), (32, same, None), (33, [0.1, None], 1), (34, [float("nan")] * 12, 1), (100, [float("inf")] * 12, 1)]
    rows += [(35, [], 1), (30000, [0.7] * 3, 1), (36, [0.25] * 40, 0)]  # other widths
    assert mined(spark, rows) == brute(rows)


def test_few_partners_and_empty(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (100, [0.0, 0.0], 3)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_repeated_rows(spark):
    rows = made(60, 2)
    assert mined(spark, rows + rows[1:30]) == brute(rows + rows[1:30])
    once, twice = mined(spark, rows), mined(spark, rows + [rows[0]])  # an anchor's copy is neither its partner nor an anchor again
    assert [x for x in twice if x[0] == 0] == [x for x in once if x[0] == 0]


@pytest.mark.parametrize("width", [32, 64, 96])
def test_bounds_hold_and_rule_out(width):
    rng = np.random.default_rng(3)

    def block(n):
        b = negatives.Block.__new__(negatives.Block)
        b.n, b.width, b.ids, b.labels = n, width, np.arange(n), np.zeros(n, int)
        b.x = np.floor(np.repeat(rng.normal(size=(n, 8)), width // 8, 1) * 100 + rng.normal(size=(n, width)) * 20).astype(np.int64)
        b.most, b.norm, b.levels = float(np.abs(b.x).max()), float(np.sqrt((b.x.astype(float) ** 2).sum(1)).max()), []
        b.width = 0
        b.x, w = b.x, width
        b.widen(w)
        return b

    q, r = block(20), block(300)
    exact = q.x @ r.x.T
    a, b = (x.ravel() for x in np.indices(exact.shape))
    for level in range(len(negatives.LEVELS)):
        low, high = negatives._pairs(q, r, level, a, b)
        assert (low <= exact.ravel()).all() and (exact.ravel() <= high).all()
    counts: list[int] = []
    least = np.sort(exact, 1)[:, -5].astype(float)
    a, b, score = negatives.survivors(q, r, np.ones_like(exact, bool), least, np.full(20, np.inf), counts)
    assert counts == sorted(counts, reverse=True) and counts[-2] < 0.5 * exact.size  # the bounds spare most exact scores
    assert {(x, y, s) for x, y, s in zip(a.tolist(), b.tolist(), score.tolist())} == {(x, y, exact[x, y]) for x in range(20) for y in range(300) if exact[x, y] >= least[x]}
