"""Toxicity scores by non-negative positive-unlabelled learning.

Features of a text are hashed: each run of letters (A-Z in lower case), and its first 4, 5 and 6 bytes, present or
absent. A few linear classifiers are trained in numpy, one to a Spark task, each on its own two thirds of a bounded
sample of confirmed toxic texts and of unlabelled texts. They minimise the risk
``prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])`` with the logistic loss l and an L1 penalty; where the
second term falls below zero, its gradient is reversed, as the non-negative estimator asks. The weights are averaged
and every whole text is scored.

Nulls: a null text counts as empty and a null doc_id belongs to the rows that may be learned from. Empty texts get the
score of the bias alone. Repeated rows are scored each. Without a confirmed example every score is 0. Empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm import words as W
from formloom.llm.shared import written

#: Bits of a feature's bucket.
BITS = 20
#: Bounds of the sample that the classifiers are fitted on: confirmed toxic texts and unlabelled texts.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Texts with more bytes than this are left out of that sample (they are scored like all others).
SAMPLE_BYTES = 200_000
#: Classifiers, and features that each of them looks at.
MEMBERS, FEATURES = 3, 3_000

_LETTERS = np.ones(256, bool)  # true: a byte between runs of letters
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all runs of letters (4 to a run, as rows), and where each text's runs begin."""
    data = W.lower(data)
    s, e, first = W.spans(data, offsets, _LETTERS)
    out = np.empty((len(s), 4), np.int32)
    shift = W.U(64 - BITS)
    out[:, 3] = (W.hashes(data, s, e) >> shift).astype(np.int32)
    for k, n in enumerate((4, 5, 6)):
        out[:, k] = (W.mix(W.hashes(data, s, np.minimum(e, s + n)) + W.U(n)) >> shift).astype(np.int32)
    return out, first


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (positive boolean, features binary) to learn from, within the bounds above."""
    usable = lambda df: df.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    by_hash = F.xxhash64("doc_id")
    positive = usable(labels).where("toxic = 1").select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(POSITIVES)
    unlabelled = usable(docs).select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(UNLABELLED)
    chosen = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(chosen), "doc_id")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in W.slices(b.column(2)):
                found, first = features(data, offsets)
                rows = [np.unique(found[x:y]).astype("<i4").tobytes() for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(rows, pa.binary())], ["doc_id", "positive", "features"])

    return texts.select("doc_id", "positive", "text").mapInArrow(distinct, "doc_id long, positive boolean, features binary")


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, l1: float = 3e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) of one classifier; rows: the distinct buckets of each text."""
    p, u = positive, ~positive
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    # the buckets whose rate among the confirmed texts lies furthest above or below the rate among the others
    in_p = np.bincount(flat[p[row]], minlength=1 << BITS) / p.sum()
    in_u = np.bincount(flat[u[row]], minlength=1 << BITS) / u.sum()
    spread = np.sqrt((in_p * (1 - in_p) + 1e-4) / p.sum() + (in_u * (1 - in_u) + 1e-4) / u.sum())
    chosen = np.sort(np.argsort(-np.abs(in_p - in_u) / spread, kind="stable")[:FEATURES])
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[flat] >= 0
    at, row = place[flat[keep]], row[keep]
    w = np.zeros(len(chosen) + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[at], minlength=len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative = np.logaddexp(0, z[u]).mean() - prior * np.logaddexp(0, z[p]).mean()
        g = np.zeros(len(rows))
        if negative >= 0:
            g[u] = s[u] / u.sum()
            g[p] = prior * (s[p] - 1) / p.sum() - prior * s[p] / p.sum()
        else:
            g[u] = -s[u] / u.sum()
            g[p] = prior * s[p] / p.sum()
        d = np.append(np.bincount(at, weights=g[row], minlength=len(chosen)), g.sum())
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w -= step * m / (1 - 0.9**t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - np.minimum(step[:-1], 1e3) * l1)
    return chosen, w[:-1], float(w[-1])


def fit(learn: DataFrame, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Averaged (buckets, weights, bias) of MEMBERS classifiers trained in as many tasks."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(MEMBERS))
    dealt = learn.withColumn("member", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(MEMBERS - 1)).cast("array<long>"), part.cast("long"))))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "positive"], kind="stable")
        positive = frame["positive"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"bucket": [], "weight": [], "bias": []}).astype({"bucket": "int32", "weight": float, "bias": float})
        b, w, bias = train([np.frombuffer(x, "<i4") for x in frame["features"]], positive, prior)
        b, w = np.append(b[w != 0], -1), np.append(w[w != 0], 0.0)
        return pd.DataFrame({"bucket": b.astype("int32"), "weight": w, "bias": bias})

    rows = dealt.groupBy("member").applyInPandas(one, "bucket int, weight double, bias double").toPandas()
    if not len(rows):
        return np.zeros(0, np.int32), np.zeros(0), -np.inf
    members = (rows["bucket"] == -1).sum()
    by = rows[rows["bucket"] >= 0].groupby("bucket")["weight"].sum() / members
    return by.index.to_numpy(np.int32), by.to_numpy(), float(rows.loc[rows["bucket"] == -1, "bias"].mean())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every text."""
    buckets, weights, bias = model
    table = np.zeros(1 << BITS, np.float32)
    table[buckets] = weights
    table = docs.sparkSession.sparkContext.broadcast(table)  # 4 MB at every size of the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        for b in batches:
            for lo, hi, data, offsets in W.slices(b.column(1)):
                found, first = features(data, offsets)
                run, k = np.nonzero(w[found])
                row = np.searchsorted(first, run, "right") - 1
                once = np.unique((row.astype(np.int64) << BITS) | found[run, k])
                z = bias + np.bincount(once >> BITS, weights=w[once & ((1 << BITS) - 1)].astype(float), minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; prior: the share of toxic texts, by default that of the labels."""
    if prior is None:
        prior = labels.where(~held_out(F.col("doc_id"))).agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0] or 0.0
    prior = min(max(prior, 1e-4), 0.9)
    model = fit(written(sample(docs, labels), "toxic-sample"), prior)
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
