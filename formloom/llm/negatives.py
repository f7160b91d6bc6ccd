"""Hard negatives by segment summaries.

A vector is cut into segments, and each segment's mean and deviation are kept with it. The inner product of two vectors is then
at most the sum over segments of length * (product of means + product of deviations), and at least the same with minus.
Finer segments bound it more closely; they are tried one level after the other, on the pairs that the level before could
not rule out, and what is left is scored exactly in 64-bit integers.

Vectors are packed into blocks of a fixed number of rows, in the fewest bytes that hold their components, and blocks of
anchors meet blocks of rows: the anchors are a stated set of queries, and each task gets a few blocks of either side and
keeps the best partners so far, whatever label or vector is frequent. Blocks are written and dealt few at a time, so that
no reader, join or batch holds more of them as tables grow. Tasks give their best partners; a window per anchor chooses among them. First each anchor's positives
are found (the best of its label), then for each of them the best rows of other labels within its band of scores; what an
anchor has already found rules out later pairs by their bounds.

Nulls: rows with a null id, label, vector or component, or one that is not finite, take no part. Shorter vectors count as
if they went on with zeros. Ties in score go by smaller id. Rows that share an id count each, but never as each other's
partner; an id is an anchor once, with its smallest label and vector. Anchors without a positive, and positives without a
negative, give no rows. Empty tables give empty results; extra columns are ignored.
Scores that may pass 2**53 raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.shared import written

#: Rows and anchors in a block.
ROWS, ANCHORS = 1024, 256
#: Bytes of vectors in a block (one vector at least), and blocks of either side that a task meets.
BLOCK_BYTES, NEAR = 1 << 19, 8
#: Numbers that are gathered at once for single pairs; where more than one pair in sixteen is left, whole products are made.
GATHERED, SPARSE = 1 << 20, 16
#: Segments of the levels, from coarse to fine; the finest summary is stored.
LEVELS = (2, 8, 32)
#: Anchor blocks whose partners a task holds at once; more are given out and begun anew.
HELD = 128

_VECTORS = "n int, width int, bytes int, ids array<long>, labels array<long>, vectors binary"
_FOUND = "anchor_id long, place int, other_id long, score long"


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each segment by level; the width of x is a multiple of the finest level's number."""
    x = x.astype(float)
    return [((p := x.reshape(len(x), g, -1)).mean(2), p.std(2)) for g in LEVELS]


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the fewest bytes a number that hold it."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def pack(rows: DataFrame, most: int, extra: str = "") -> DataFrame:
    """Rows (vec_id, label, v, and the columns named in `extra`: lists of longs) as blocks of at most `most`."""
    names = [x.split()[0] for x in extra.split(",") if x.strip()]
    schema = ", ".join([_VECTORS, *(f"{n} array<array<long>>" for n in names)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), most):
                part = b.slice(lo, most)
                lists = part.column(2)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                width = -(-max(1, int(sizes.max())) // LEVELS[-1]) * LEVELS[-1]
                x = np.zeros((len(part), width), np.int64)
                x[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
                x = _narrow(x)
                one = lambda a: pa.array([np.ravel(a)], pa.list_(pa.int64()))
                step = max(1, BLOCK_BYTES // (width * x.itemsize))
                for at in range(0, len(part), step):
                    some, own = part.slice(at, step), x[at : at + step]
                    columns = [pa.array([len(own)], pa.int32()), pa.array([width], pa.int32()), pa.array([x.itemsize], pa.int32()), one(some.column(0)), one(some.column(1)), pa.array([own.tobytes()], pa.binary())]
                    columns += [pa.array([some.column(3 + k).to_pylist()], pa.list_(pa.list_(pa.int64()))) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return rows.select("vec_id", "label", "v", *names).mapInArrow(packed, schema)


class Block:
    """A block read back: ids, labels, vectors and their summaries by level."""

    def __init__(self, b: pa.RecordBatch, k: int, prefix: str):
        get = lambda name: b.column(prefix + name)[k].values.to_numpy(zero_copy_only=False)
        self.n, self.width = b.column(prefix + "n")[k].as_py(), b.column(prefix + "width")[k].as_py()
        self.ids, self.labels = get("ids"), get("labels")
        kept = np.frombuffer(b.column(prefix + "vectors")[k].as_buffer(), f"i{b.column(prefix + 'bytes')[k].as_py()}")
        self.x = kept.reshape(self.n, self.width).astype(np.int64)
        self.levels = _summaries(self.x)
        self.most = float(np.abs(self.x.astype(float)).max(initial=0))
        self.norm = float(np.sqrt((self.x.astype(float) ** 2).sum(1)).max(initial=0))

    def widen(self, width: int) -> None:
        """The block with zeros after its vectors; the summaries are made anew."""
        if width > self.width:
            self.x, self.width = _widened(self.x, width), width
            self.levels = _summaries(self.x)


def _pairs(q: Block, r: Block, level: int, a: np.ndarray | None, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of pairs (a, b), or of all pairs as a matrix."""
    (qm, qd), (rm, rd) = q.levels[level], r.levels[level]
    length, slack = q.width // LEVELS[level], 1e-9 * q.norm * r.norm + 1e-6  # for what rounding may add
    if a is None:
        middle, off = length * (qm @ rm.T), length * (qd @ rd.T) + slack
    else:
        middle, off = length * np.einsum("ij,ij->i", qm[a], rm[b]), length * np.einsum("ij,ij->i", qd[a], rd[b]) + slack
    return middle - off, middle + off


def survivors(q: Block, r: Block, open_: np.ndarray, least: np.ndarray, most: np.ndarray, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The open pairs whose score may lie between their anchor's `least` and `most`, with their exact scores.

    counts, where given, gets how many pairs each level and the exact scores left.
    """
    width = max(q.width, r.width)
    q.widen(width)
    r.widen(width)
    if q.most * r.most * width >= 2**53:
        raise ArithmeticError("the vectors' components are too large for exact scores")
    between = lambda low, high, a: (high >= least[a]) & (low <= most[a])
    few = lambda a: len(a) * SPARSE < q.n * r.n

    def gathered(work: Callable, a: np.ndarray, b: np.ndarray, each: int) -> tuple[np.ndarray, ...]:
        step = max(1, GATHERED // each)
        return tuple(map(np.concatenate, zip(*(work(a[k : k + step], b[k : k + step]) for k in range(0, max(1, len(a)), step)))))

    low, high = _pairs(q, r, 0, None, None)
    a, b = np.nonzero(open_ & (high >= least[:, None]) & (low <= most[:, None]))
    left = [len(a)]
    for level in range(1, len(LEVELS)):
        if few(a):
            low, high = gathered(lambda a, b: _pairs(q, r, level, a, b), a, b, LEVELS[level])
        else:
            low, high = (x[a, b] for x in _pairs(q, r, level, None, None))
        keep = between(low, high, a)
        a, b = a[keep], b[keep]
        left.append(len(a))
    if few(a):
        (score,) = gathered(lambda a, b: (np.einsum("ij,ij->i", q.x[a], r.x[b]),), a, b, width)
    else:  # exact in doubles too, as every sum stays below 2**53
        score = (q.x.astype(float) @ r.x.T.astype(float))[a, b].astype(np.int64)
    keep = between(score, score, a)
    if counts is not None:
        counts[:] = [*left, int(keep.sum())]
    return a[keep], b[keep], score[keep]


def _leading(key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their run of equal keys, ties with the last of them included."""
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(begins, append=len(key))
    if sizes.max() <= k:
        return np.ones(len(key), bool)
    run = np.repeat(np.arange(len(begins)), sizes)
    table = np.full((len(begins), sizes.max()), -np.inf)
    table[run, np.arange(len(key)) - begins[run]] = score
    return score >= np.partition(table, -k, 1)[:, -k][run]


class Best:
    """The best partners so far of a number of lists: by score, then by smaller id."""

    def __init__(self, lists: int, k: int):
        self.k, self.lists = k, lists
        self.key = self.id = self.score = np.zeros(0, np.int64)
        self.worst = np.full(lists, -np.inf)  # what a newcomer must reach

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(key):
            return
        lead = _leading(key, score, self.k)
        key, ids, score = key[lead], ids[lead], score[lead]
        key, ids, score = (np.concatenate(x) for x in ((self.key, key), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.k
        self.key, self.id, self.score = key[keep], ids[keep], score[keep]
        last = place == self.k - 1
        self.worst[key[last]] = score[last]


def _searched(pairs: DataFrame, begin: Callable, step: Callable) -> DataFrame:
    """Each task's best partners. begin(block, batch, k) makes an anchor block's state, step(state, block) takes in rows."""

    def given(state: dict) -> pa.RecordBatch:
        best, ids, places = state["best"], state["block"].ids, state["places"]
        return pa.RecordBatch.from_arrays([pa.array(ids[best.key // places]), pa.array((best.key % places).astype(np.int32)), pa.array(best.id), pa.array(best.score)], ["anchor_id", "place", "other_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, dict] = {}
        for b in batches:
            for k in range(len(b)):
                rows = Block(b, k, "r_")
                name = b.column("q_ids")[k].values[0].as_py()  # anchors are there once each, so the first names the block
                if name not in states:
                    if len(states) >= HELD:
                        yield given(states.pop(next(iter(states))))
                    states[name] = begin(Block(b, k, "q_"), b, k)
                step(states[name], rows)
        for state in states.values():
            yield given(state)

    return pairs.mapInArrow(search, _FOUND)


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors with every block of rows, about NEAR of either side in a task."""
    named = lambda df, p: df.repartition(max(1, -(-df.count() // NEAR))).select([F.col(c).alias(p + c) for c in df.columns])
    return named(anchors, "q_").crossJoin(named(rows, "r_").hint("shuffle_replicate_nl"))


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best k partners of each (anchor, place), numbered from 1."""
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _open_positives(q: Block, r: Block) -> np.ndarray:
    return (q.labels[:, None] == r.labels) & (q.ids[:, None] != r.ids)


def positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """anchor_id, rank, other_id and score of the best k rows of each anchor's label; both sides packed."""

    def begin(block: Block, b: pa.RecordBatch, at: int) -> dict:
        return {"block": block, "places": 1, "best": Best(block.n, k)}

    def step(state: dict, rows: Block) -> None:
        q, best = state["block"], state["best"]
        a, b, score = survivors(q, rows, _open_positives(q, rows), best.worst, np.full(q.n, np.inf))
        best.add(a, rows.ids[b], score)

    return _first(_searched(_met(anchors, rows), begin, step), k)


def negatives(anchors: DataFrame, rows: DataFrame, places: int, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, place, rank, other_id, score of the best k rows of other labels for each positive of packed anchors.

    A row's score times 100 lies between low and high times the positive's score. The anchors' column `scores` lists
    their positives' scores, at most `places`.
    """

    def begin(block: Block, b: pa.RecordBatch, at: int) -> dict:
        given = [x.as_py() for x in b.column("q_scores")[at].values]
        from_, to = np.full((block.n, places), np.inf), np.full((block.n, places), -np.inf)
        for n, scores in enumerate(given):
            for p, s in enumerate(scores):
                from_[n, p], to[n, p] = -(-low * s // 100), high * s // 100
        return {"block": block, "places": places, "best": Best(block.n * places, k), "from": from_, "to": to}

    def step(state: dict, rows: Block) -> None:
        q, best = state["block"], state["best"]
        worst = best.worst.reshape(q.n, places)
        least = np.maximum(state["from"], worst)
        open_ = (q.labels[:, None] != rows.labels) & (q.ids[:, None] != rows.ids)
        a, b, score = survivors(q, rows, open_, least.min(1), state["to"].max(1))
        for p in range(places):
            fit = (score >= least[a, p]) & (score <= state["to"][a, p])
            best.add(a[fit] * places + p, rows.ids[b[fit]], score[fit])

    return _first(_searched(_met(anchors, rows), begin, step), k)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for vectors (vec_id, label, v: longs)."""
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v")
    blocks = written(pack(rows, ROWS), "vectors", NEAR)
    one = F.min(F.struct("label", "v")).alias("one")
    anchors = written(rows.where(is_anchor).groupBy("vec_id").agg(one).select("vec_id", "one.label", "one.v"), "anchors")
    found = written(positives(written(pack(anchors, ANCHORS), "anchor-blocks", NEAR), blocks, n_positives), "positives")
    scores = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    asking = written(pack(anchors.join(scores, "vec_id"), ANCHORS, "scores long"), "asking-blocks", NEAR)
    best = negatives(asking, blocks, n_positives, n_negatives, low, high)
    names = found.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(names, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
