"""A hashed maximum-entropy language model with a class-factored softmax.

``p(token | history) = p(class | history) * p(token | class, history)``. The class is predicted by a maximum-entropy model
on hashed features of the history: the last token and, skipping one, the token before it. Within a class, a token's score
is its bias, log p(token | class), plus the weight of the pair (last token, token) if the model has one:
``p(token | class, last) = exp(bias + weight) / Z(last, class)``. Only pairs with a weight change Z, so that Z is a sum
over few pairs. The most frequent tokens are classes of their own; the other frequent tokens are grouped by the frequent
token that they last follow; the tail of the frequent tokens and all rarer tokens make two more classes.

Training: the counts of tokens and of pairs are gathered over all training texts, as tables that grow with them. The
weights of the classes are trained in a few rounds, each on another part of the training texts: every task starts from
the weights of the last round, makes gradient steps on small batches of its own texts, and the rows it touched are
averaged with those of the other tasks, weighted by how often they were used. The weights of the pairs have an L1 penalty
of one count; given the pair counts, those of one last token and class do not depend on any others, so tasks take them
by group and make scaled gradient steps on the expected counts. The PAIRS weights that gain most go to all tasks.

Only tokens that are among the VOCABULARY most frequent go to all tasks. The others are looked up in the table of all
counts by a join, so every token's exact count enters the scores. Tokens are compared by 64-bit hashes.

Nulls: a null text is an empty one (its only token is the end). A null doc_id belongs to the training rows. Repeated
rows are scored each and counted each. Without training rows every token is unknown. Empty tables give empty results.
Extra columns are ignored.
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

#: Tokens that every task knows, at most; those of them that are grouped by context; classes with one token.
VOCABULARY, GROUPED, SINGLE = 1 << 17, 1 << 14, 32
#: Classes: SINGLE with one token (one of them the end), the groups, the tail and the rare tokens.
CLASSES = 64
#: Rows of the weights for the last token and for the one before.
ROWS = (1 << 14, 1 << 14)
ROUNDS, BATCH, RATE = 2, 16384, 0.25
#: Last tokens that have pairs (the most frequent ones and the start of a text), and weights of pairs that go to all tasks.
HEADS, PAIRS = 1 << 14, 1 << 20
#: The L1 penalty of a pair's weight, in counts, and gradient steps.
PENALTY, STEPS = 1.0, 15
#: Counts held by a task before it passes them on.
HELD = 1 << 20

_STARTS = np.concatenate([[0], np.cumsum(ROWS)])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in W.slices(column):
        data = W.lower(data)
        s, e, first = W.spans(data, offsets)
        yield lo, hi, W.hashes(data, s, e), first


def token_counts(texts: DataFrame) -> DataFrame:
    """(w, c): how often each word occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], ["w", "c"])

        for b in batches:
            for _, _, h, _ in _hashed(b.column(0)):
                held.append(h)
                size += len(h)
                if size >= HELD:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    return texts.select("text").mapInArrow(counted, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Table:
    """Looks up 64-bit keys: open addressing with linear probing, all keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = W.U(63 - max(4, len(keys)).bit_length())  # at least twice as many slots as keys
        slot = (W.mix(keys.view(W.U)) >> self.shift).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        n = np.arange(len(keys))
        place = n + np.maximum.accumulate(slot[order] - n) if len(keys) else n
        self.slots = np.full(max(1 << (64 - int(self.shift)), int(place[-1]) + 1 if len(keys) else 0) + 1, -1, np.int32)
        self.slots[place] = order

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The index of each asked key, or -1."""
        at = (W.mix(asked.view(W.U)) >> self.shift).astype(np.int64)
        out = self.slots[at]
        if not len(self.keys):
            return out.astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != asked))
        while len(open_):
            at[open_] += 1
            out[open_] = found = self.slots[at[open_]]
            open_ = open_[(found >= 0) & (self.keys[found] != asked[open_])]
        return out.astype(np.int64)


class Model:
    """What all tasks know: the frequent tokens with their counts and classes, the totals, and the weights."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, docs: int, total: int, distinct: int):
        """hashes and counts of the frequent words; total and distinct of all words; docs: training texts."""
        order = np.argsort(-counts, kind="stable")
        self.hash, self.count = hashes[order], counts[order].astype(np.int64)
        self.table = Table(self.hash)
        k = len(self.hash)
        self.end, self.rare, self.start = k, k + 1, k + 2
        self.tokens, self.distinct = total + docs, distinct + (docs > 0)
        self.docs = docs
        self.rare_size = float(total - self.count.sum() + distinct - k + 1)
        self.cls = np.full(k + 2, CLASSES - 2)
        self.cls[: min(k, SINGLE - 1)] = np.arange(min(k, SINGLE - 1))
        self.cls[self.end], self.cls[self.rare] = SINGLE - 1, CLASSES - 1
        self.rows = [_STARTS[n].astype(np.int32) + (W.mix(np.arange(k + 3).astype(W.U) + W.U(n * 0x51ED27)) >> W.U(64 - int(np.log2(r)))).astype(np.int32) for n, r in enumerate(ROWS)]
        self.weights = np.zeros((_STARTS[-1], CLASSES), np.float32)
        self.pairs, self.pair_weights, self.norms = Table(np.zeros(0, np.int64)), np.zeros(0, np.float32), np.zeros(0, np.float32)
        self._set_bias()

    def _set_bias(self) -> None:
        """Class shares, and each token's share in its class."""
        counts = np.concatenate([self.count, [self.docs, 0]]).astype(float)
        self.class_count = np.bincount(self.cls, weights=counts, minlength=CLASSES)
        self.class_count[-1] = self.rare_size
        self.bias = np.log(self.class_count + 0.5).astype(np.float32) - np.float32(np.log((self.class_count + 0.5).sum()))
        with np.errstate(divide="ignore", invalid="ignore"):
            self.inside = np.log10(counts) - np.log10(self.class_count[self.cls])
        self.inside[self.rare] = -np.log10(self.rare_size)
        if not self.docs:
            self.inside[self.end] = 0.0

    def group(self, cells: np.ndarray, counts: np.ndarray) -> None:
        """Deals the GROUPED tokens after the single ones into classes by k-means on the tokens that they last follow."""
        k, groups = len(self.hash), CLASSES - 2 - SINGLE
        some = np.arange(SINGLE - 1, min(k, GROUPED))
        if len(some) < groups:
            return
        table = np.zeros((min(k, GROUPED), SINGLE + 1), np.float32)
        table[cells // (SINGLE + 1), cells % (SINGLE + 1)] = counts
        x = np.sqrt(table[some] / np.maximum(1, table[some].sum(axis=1, keepdims=True)))
        weight = self.count[some]
        centres = x[np.linspace(0, len(some) - 1, groups).astype(int)]
        for _ in range(15):
            near = np.argmax(x @ centres.T, axis=1)
            for g in range(groups):
                if (mine := near == g).any():
                    centres[g] = (x[mine] * weight[mine, None]).sum(axis=0)
                    centres[g] /= np.linalg.norm(centres[g]) + 1e-9
        self.cls[some] = SINGLE + near
        self._set_bias()

    def ids(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of texts with their ends, the last token and the one before of each, and the texts' token places."""
        found = self.table.find(h)
        found[found < 0] = self.rare
        texts = len(first) - 1
        places = first + np.arange(texts + 1)
        ids = np.full(len(h) + texts, self.end)
        ids[np.arange(len(h)) + W.row_of(first)] = found
        last, before = np.full(len(ids), self.start), np.full(len(ids), self.start)
        last[1:], before[2:] = ids[:-1], ids[:-2]
        last[places[:-1]] = self.start
        before[places[:-1]] = self.start
        second = places[:-1] + 1
        before[second[second < places[1:]]] = self.start
        return ids, last, before, places

    def features(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the weights for each token, by feature."""
        return self.rows[0][last], self.rows[1][before]

    def pair_keys(self, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens may have a weight with the token before them, and the keys of those pairs."""
        head = np.where(last == self.start, HEADS, last)
        some = np.flatnonzero(((last < min(HEADS, self.end)) | (last == self.start)) & (self.cls[ids] >= SINGLE) & (ids < self.end))
        return some, head[some] * (self.end + 1) + ids[some]

    def set_pairs(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Takes the weights of pairs and sums up Z of each last token and class."""
        self.pairs, self.pair_weights = Table(keys), weights.astype(np.float32)
        w = keys % (self.end + 1)
        cell = keys // (self.end + 1) * CLASSES + self.cls[w]
        more = np.bincount(cell, weights=10 ** self.inside[w] * np.expm1(weights.astype(np.float32).astype(float)), minlength=(HEADS + 1) * CLASSES)
        self.norms = np.log10(1 + more).astype(np.float32)

    def logs(self, ids: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 of the predicted share of each token (of each count of it, if it is rare)."""
        out = self.class_logs(self.features(last, before), self.cls[ids]) + self.inside[ids]
        if len(self.norms):
            some, keys = self.pair_keys(ids, last)
            at = self.pairs.find(keys)
            found = at >= 0
            out[some] -= self.norms[keys // (self.end + 1) * CLASSES + self.cls[ids[some]]]
            out[some[found]] += self.pair_weights[at[found]] / np.log(10)
        return out

    def class_logs(self, f: tuple[np.ndarray, np.ndarray], cls: np.ndarray) -> np.ndarray:
        """log10 of the predicted share of each token's class."""
        out = np.empty(len(cls))
        for lo in range(0, len(cls), 4096):
            y = cls[lo : lo + 4096]
            z = self._scores([x[lo : lo + 4096] for x in f], self.weights)
            z -= z.max(axis=1, keepdims=True)
            out[lo : lo + 4096] = z[np.arange(len(z)), y] - np.log(np.exp(z).sum(axis=1))
        return out / np.log(10)

    def _scores(self, f: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
        z = weights[f[0]]
        z += weights[f[1]]
        z += self.bias
        return z


def step(model: Model, weights: np.ndarray, squares: np.ndarray, used: np.ndarray, f: list[np.ndarray], cls: np.ndarray) -> None:
    """One gradient step on a batch; the rate of a row falls with the squares of its gradients so far."""
    z = model._scores(f, weights)
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(len(z)), cls] -= 1
    for x in f:
        order = np.argsort(x.astype(np.uint16), kind="stable")  # rows are fewer than 2**16
        rows = x[order]
        begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        g = np.add.reduceat(z[order], begin, axis=0)
        rows = rows[begin]
        squares[rows] += np.einsum("ij,ij->i", g, g) / CLASSES
        g *= (RATE / np.sqrt(squares[rows] + 1e-3))[:, None]
        weights[rows] -= g
        used[rows] += np.diff(np.r_[begin, len(order)])


def pair_weights(group: np.ndarray, bias: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The weights of pairs under an L1 penalty; 0 where the bias alone predicts a pair well enough.

    group: number of the pair's last token and class; bias: log p(token | class); count: of the pair; total: of the group.
    Each step moves a weight by the log of its penalised count over its expected count.
    """
    share = np.exp(bias)
    weight = np.zeros(len(group))
    least = np.log(np.maximum(count - PENALTY, 1e-9))
    for _ in range(STEPS):
        z = 1 + np.bincount(group, weights=share * np.expm1(weight))
        weight = np.maximum(0, least - np.log(total * share / z[group]))
    return weight


def _gathered(texts: DataFrame, shared) -> DataFrame:
    """(key, c): how often each pair occurs, and as -1 - cell how often each grouped token follows each single token (the last one before it)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n = min(len(m.hash), GROUPED)
        table = np.zeros(n * (SINGLE + 1), np.int64)
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c.astype(np.int64))], ["key", "c"])

        for b in batches:
            for _, _, h, first in _hashed(b.column(0)):
                ids, last, _, places = m.ids(h, first)
                single = m.cls[ids] < SINGLE
                # the place of the last single token before each token; a text's first tokens have none
                at = np.where(single, np.arange(len(ids)), -1)
                at = np.r_[-1, np.maximum.accumulate(at)[:-1]]
                begins = np.repeat(places[:-1], np.diff(places))
                context = np.where(at >= begins, m.cls[ids[at]], SINGLE)
                some = ids < n
                table += np.bincount(ids[some] * (SINGLE + 1) + context[some], minlength=len(table))
                held.append(m.pair_keys(ids, last)[1])
                size += len(held[-1])
                if size >= 2 * HELD:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(-1 - cells), pa.array(table[cells])], ["key", "c"])

    return texts.select("text").mapInArrow(counted, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _fitted_pairs(pairs: DataFrame, shared) -> DataFrame:
    """(key, weight, gain) of the pairs with a weight above 0; pairs: key, c."""
    width = shared.value.end + 1

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value.cls
        for b in batches:
            key = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key // width * CLASSES + cls[key % width])], ["key", "c", "cell"])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        key, c = frame["key"].to_numpy(), frame["c"].to_numpy(float)
        _, cell = np.unique(frame["cell"].to_numpy(), return_inverse=True)
        total = np.bincount(cell, weights=c)[cell]
        some = c > PENALTY
        key, c, total, cell = key[some], c[some], total[some], cell[some]
        weight = pair_weights(cell, shared.value.inside[key % width] * np.log(10), c, total) if len(key) else np.zeros(0)
        some = weight > 0
        return pd.DataFrame({"key": key[some], "weight": weight[some], "gain": (c * weight)[some]})

    # all pairs of a last token and class meet, at most VOCABULARY of them; a task gets many of these
    parts = F.pmod(F.xxhash64("cell"), F.lit(4096)).alias("part")
    dealt = pairs.mapInArrow(grouped, "key long, c long, cell long").select("key", "c", "cell", parts)
    return dealt.groupBy("part").applyInPandas(fitted, "key long, weight double, gain double")


def _trained(texts: DataFrame, shared) -> np.ndarray:
    """The weights after one round of gradient steps in all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights, squares, used = m.weights.copy(), np.zeros(_STARTS[-1], np.float32), np.zeros(_STARTS[-1], np.int64)
        for b in batches:
            for _, _, h, first in _hashed(b.column(0)):
                ids, last, before, _ = m.ids(h, first)
                f, cls = m.features(last, before), m.cls[ids]
                for lo in range(0, len(cls), BATCH):
                    step(m, weights, squares, used, [x[lo : lo + BATCH] for x in f], cls[lo : lo + BATCH])
        rows = np.flatnonzero(used)
        for lo in range(0, len(rows), 2000):
            some = rows[lo : lo + 2000]
            sums = (weights[some] - m.weights[some]) * used[some, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(some // 256), pa.array(some), pa.array(used[some]), pa.array([x.tobytes() for x in sums], pa.binary())], ["part", "row", "used", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["row"].to_numpy() % 256
        sums, used = np.zeros((256, CLASSES)), np.zeros(256)
        for k, n, x in zip(at, frame["used"], frame["sums"]):
            sums[k] += np.frombuffer(x, np.float32)
            used[k] += n
        rows = np.flatnonzero(used)
        mean = (sums[rows] / used[rows, None]).astype(np.float32)
        return pd.DataFrame({"row": rows + int(frame["row"].iloc[0]) // 256 * 256, "mean": [x.tobytes() for x in mean]})

    touched = texts.select("text").mapInArrow(run, "part long, row long, used long, sums binary")
    means = touched.groupBy("part").applyInPandas(added, "row long, mean binary").toArrow()  # at most sum(ROWS) rows
    weights = shared.value.weights.copy()
    if len(means):
        weights[means["row"].to_numpy()] += np.frombuffer(b"".join(means["mean"].to_pylist()), np.float32).reshape(-1, CLASSES)
    return weights


def _largest(table: DataFrame, column: str, most: int, *carry: str) -> tuple[pa.Table, int, int]:
    """Rows of `table` (columns carry) with the largest values of a column, about `most` of them and not more, in the order of
    the first of carry; how many rows there are and the sum of the column."""
    step = F.floor(F.log2(column) * 8).cast("int")
    sizes = table.groupBy(step.alias("size")).agg(F.count("*").alias("n"), F.sum(column).alias("total")).collect()  # few: logarithms
    least, room = None, most
    for r in sorted(sizes, key=lambda r: -r["size"]):
        if (room := room - r.n) < 0:
            break
        least = r["size"]
    kept = table.where(step >= least if least is not None else F.lit(False)).select(*carry).toArrow()
    return kept.sort_by(carry[0]), sum(r.n for r in sizes), sum(r.total for r in sizes)


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words, from the texts of `train` (doc_id, text)."""
    spark = train.sparkSession
    counts = written(token_counts(train), "token-counts")
    docs = train.count()
    frequent, distinct, total = _largest(counts, "c", VOCABULARY, "w", "c")
    model = Model(frequent["w"].to_numpy().view(W.U), frequent["c"].to_numpy(), docs, total, distinct)
    gathered = written(_gathered(train, shared := spark.sparkContext.broadcast(model)), "pair-counts")
    cells = gathered.where("key < 0").toArrow()  # at most GROUPED * (SINGLE + 1) rows
    model.group(-1 - cells["key"].to_numpy(), cells["c"].to_numpy())
    shared.destroy()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        model.weights = _trained(train.where(part == k), shared := spark.sparkContext.broadcast(model))
        shared.destroy()
    fitted = written(_fitted_pairs(gathered.where("key >= 0"), shared := spark.sparkContext.broadcast(model)), "pair-weights")
    weights, _, _ = _largest(fitted, "gain", PAIRS, "key", "weight")
    shared.destroy()
    model.set_pairs(weights["key"].to_numpy(), weights["weight"].to_numpy())
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base_size = float(np.log10(model.tokens + model.distinct + 1))
    names = ["doc_id", "key", "n_tokens", "known", "base", "score", "n_rare", "rare"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        counts = np.concatenate([m.count, [m.docs, 0]])
        logs = np.log10(counts + 1.0)
        for b in batches:
            for lo, hi, h, first in _hashed(b.column(2)):
                ids, last, before, places = m.ids(h, first)
                each = m.logs(ids, last, before)
                tokens = np.diff(places)
                known = np.add.reduceat((counts[ids] > 0).astype(np.int64), places[:-1])
                base = np.add.reduceat(logs[ids], places[:-1]) - tokens * base_size
                is_rare = np.delete(ids, places[1:] - 1) == m.rare
                row = W.row_of(first)[is_rare]
                n_rare = np.bincount(row, minlength=hi - lo)
                cut = np.concatenate([[0], np.cumsum(n_rare)])
                rare = h[is_rare].tobytes()
                arrays = [pa.array(tokens), pa.array(known), pa.array(base), pa.array(np.add.reduceat(each, places[:-1])), pa.array(n_rare), pa.array([rare[8 * x : 8 * y] for x, y in zip(cut[:-1], cut[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], *arrays], names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                rare = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rare)), pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in rare]))], ["w", "key"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    done = written(keyed.mapInArrow(scored, "doc_id long, key long, n_tokens long, known long, base double, score double, n_rare long, rare binary"), "scored")
    rare = done.where("n_rare > 0").select("key", "rare").mapInArrow(spread, "w long, key long")
    looked = rare.join(counts, "w", "left").groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"), F.count("c").alias("seen"), F.count("*").alias("t"))
    out = done.drop("rare").join(looked, "key", "left")
    part = F.coalesce(F.col("n_rare") / F.col("t"), F.lit(0.0))  # below 1 where rows with equal texts share a key
    logs = F.coalesce(F.col("logs") * part, F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce(F.round(F.col("seen") * part).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from the rows not held out."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model, counts = fit(texts.where(~held_out(F.col("doc_id"))))
    out = score(texts, model, counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *out.columns[1:])
