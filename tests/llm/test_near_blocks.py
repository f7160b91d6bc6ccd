"""What a task of the hard negatives holds stays small, whatever the tables' size, and what it finds stays the same."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import negatives
from formloom.llm.shared import written


def rows(spark, n, width, top=200):
    df = spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"))
    return df.withColumn("v", F.expr(f"transform(sequence(1, {width}), k -> CAST((vec_id * 37 + k * 101) % {2 * top} - {top} AS BIGINT))"))


@pytest.mark.parametrize("top, size", [(100, 1), (200, 2), (40000, 4), (1 << 33, 8)])
def test_blocks_hold_numbers_in_few_bytes(spark, monkeypatch, top, size):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 64 * 32 * size)
    got = negatives.pack(rows(spark, 500, 64, top).coalesce(1), 256).collect()
    assert max(b["bytes"] for b in got) == size and all(len(b["vectors"]) <= 64 * 32 * size for b in got)
    vectors = {i: v for b in got for i, v in zip(b["ids"], np.frombuffer(b["vectors"], f"i{b['bytes']}").reshape(b["n"], b["width"]).tolist())}
    assert vectors == {r["vec_id"]: r["v"] for r in rows(spark, 500, 64, top).collect()}


def test_a_task_meets_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "NEAR", 4)
    blocks = written(negatives.pack(rows(spark, 640, 32).coalesce(1), 16), "blocks", negatives.NEAR)
    asking = written(negatives.pack(rows(spark, 96, 32).coalesce(1), 8), "asking", negatives.NEAR)
    assert len(blocks.inputFiles()) == 10
    assert negatives._met(asking, blocks).rdd.getNumPartitions() == 10 * 3
    assert negatives._met(asking, blocks).count() == 40 * 12


def block(n, seed, width=64):
    b, rng = negatives.Block.__new__(negatives.Block), np.random.default_rng(seed)
    b.n, b.width, b.ids, b.labels, b.x = n, 0, np.arange(n), np.zeros(n, int), rng.integers(-200, 200, (n, width))
    b.most, b.norm = 200.0, float(np.sqrt((b.x**2).sum(1)).max())
    b.widen(width)
    return b


@pytest.mark.parametrize("share", [0.0, 0.5, 0.99, 1.0])
def test_pairs_are_scored_in_little_memory(share):
    q, r = block(256, 1), block(1024, 2)
    exact = q.x @ r.x.T
    least = np.quantile(exact, share, axis=1)
    tracemalloc.start()
    a, b, score = negatives.survivors(q, r, np.ones_like(exact, bool), least, np.full(256, np.inf))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20
    want = np.nonzero(exact >= least[:, None])
    assert (a == want[0]).all() and (b == want[1]).all() and score.dtype == np.int64 and (score == exact[want]).all()


def test_pruning_keeps_the_best_and_ties():
    rng = np.random.default_rng(4)
    key, score, ids = np.sort(rng.integers(0, 9, 600)), rng.integers(0, 12, 600), rng.permutation(600)
    best = negatives.Best(9, 5)
    for part in np.array_split(np.arange(600), 3):
        best.add(key[part], ids[part], score[part])
    want = [(k, *x) for k in range(9) for x in sorted((-s, i) for j, i, s in zip(key.tolist(), ids.tolist(), score.tolist()) if j == k)[:5]]
    assert list(zip(best.key.tolist(), (-best.score).tolist(), best.id.tolist())) == want
