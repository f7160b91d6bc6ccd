"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

The test items are indexed in blocks of bounded size, each in a task; one after the other goes to all tasks, and every
document is read once for each block. Document frequencies and the mean length are those of the whole benchmark, whatever block an item is in.
A document is cut into passages that overlap by half, twice as long as the longest item of a length
class, so that any copy of an item lies whole in one passage. Every passage is a query. Impacts are BM25 scores
divided by the score that the item gets from its own text, so one threshold serves all items. Passages whose largest
impacts in every run of ITEMS items stay below the threshold are passed over at once; the others go through block-max
WAND, which returns all items above the threshold. An item counts as found if enough of the word trigrams of its
question (its first two thirds) and of its answer (the rest) occur in the passage.

Words are runs of letters and digits, A-Z in lower case. Nulls: a null text has no words; items without words are
never found. Repeated rows are judged each; items with equal text are found each. Empty tables give documents without
hits. Extra columns are kept by hits(), which adds the column `hits`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm import words as W
from formloom.llm.shared import written

#: Items in one block of the index, on average.
BLOCK_ITEMS = 2048
#: Postings that share one block maximum.
POSTINGS = 16
#: Items that share one largest impact when passages are passed over.
ITEMS = 4
K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER = 0.6, 0.5, 0.4

HIT = "struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>"
_GAP = np.ones(256, bool)
_GAP[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = False


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = W.lower(data)
    s, e, first = W.spans(data, offsets, _GAP)
    return W.hashes(data, s, e), first


class Index:
    """Items of one length class: postings by term, in order of item, with impacts and their block maxima."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: dict[int, float], mean: float):
        self.ids = [i for i, _ in items]
        self.longest = max(len(w) for _, w in items)
        self.grams = []
        lists: dict[int, list[tuple[int, float]]] = {}
        for k, (_, w) in enumerate(items):
            terms, tf = np.unique(w, return_counts=True)
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = np.array([idf[int(t)] for t in terms]) * tf * (K1 + 1) / (tf + norm)
            for t, x in zip(terms.tolist(), (impact / impact.sum()).tolist()):
                lists.setdefault(t, []).append((k, x))
            cut = -(-2 * len(w) // 3)
            self.grams.append((np.unique(W.grams(w[:cut], min(3, cut))), np.unique(W.grams(w[cut - min(2, cut) :], 3)) if len(w) > cut else np.zeros(0, W.U)))
        self.terms = np.array(sorted(lists), W.U)
        self.docs = [np.array([k for k, _ in lists[t]]) for t in self.terms.tolist()]
        self.impacts = [np.array([x for _, x in lists[t]]) for t in self.terms.tolist()]
        self.blocks = [np.maximum.reduceat(x, np.arange(0, len(x), POSTINGS)) for x in self.impacts]
        self.most = np.array([x.max() for x in self.impacts])
        # the largest impact of each term in each run of ITEMS items; a last row of zeros for unknown terms
        self.block_most = np.zeros((len(self.terms) + 1, -(-len(items) // ITEMS)), np.float32)
        for t, (d, x) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.block_most[t], d // ITEMS, x)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose summed impact over `terms` reaches the threshold: document at a time, block-max WAND."""
        end = len(self.ids)
        docs, impacts, blocks = ([x[t] for t in terms] for x in (self.docs, self.impacts, self.blocks))
        most, at = [float(self.most[t]) for t in terms], [0] * len(terms)
        here = [int(d[0]) for d in docs]

        def advance(k: int, to: int) -> None:
            at[k] += int(np.searchsorted(docs[k][at[k] :], to))
            here[k] = int(docs[k][at[k]]) if at[k] < len(docs[k]) else end

        found = []
        threshold -= 1e-9
        while True:
            order = sorted(range(len(terms)), key=here.__getitem__)
            total, pivot = 0.0, -1
            for n, k in enumerate(order):
                if here[k] == end:
                    break
                total += most[k]
                if total >= threshold:
                    pivot = n
                    break
            if pivot < 0:
                return found
            doc = here[order[pivot]]
            while pivot + 1 < len(order) and here[order[pivot + 1]] == doc:
                pivot += 1
            bound, leave = 0.0, end if pivot + 1 == len(order) else here[order[pivot + 1]]
            for k in order[: pivot + 1]:
                b = (at[k] + int(np.searchsorted(docs[k][at[k] :], doc))) // POSTINGS
                if b < len(blocks[k]):
                    bound += float(blocks[k][b])
                    last = min((b + 1) * POSTINGS, len(docs[k])) - 1
                    leave = min(leave, int(docs[k][last]) + 1)
            if bound < threshold:
                for k in order[: pivot + 1]:
                    advance(k, max(leave, doc + 1))
            elif here[order[0]] == doc:
                score = sum(float(impacts[k][at[k]]) for k in order[: pivot + 1])
                if score >= threshold:
                    found.append((doc, score))
                for k in order[: pivot + 1]:
                    advance(k, doc + 1)
            else:
                for k in order[:pivot]:
                    if here[k] < doc:
                        advance(k, doc)

    def overlap(self, item: int, grams: np.ndarray) -> tuple[float, float]:
        """Shares of the trigrams of the item's question and answer that are among `grams`."""
        q, a = self.grams[item]
        share = lambda x: float(np.isin(x, grams).mean()) if len(x) else 1.0
        return share(q), share(a)


def indexes(items: list[tuple[int, str]], idf: dict[int, float] | None = None, mean: float | None = None) -> list[Index]:
    """One index for each class of item lengths (up to 16, 32, 64 ... words)."""
    column = pa.array([t or "" for _, t in items], pa.string())
    hashed: list[np.ndarray] = []
    for _, _, data, offsets in W.slices(column):
        h, first = words(data, offsets)
        hashed += [h[x:y] for x, y in zip(first[:-1], first[1:])]
    given = [(i, h) for (i, _), h in zip(items, hashed) if len(h)]
    if not given:
        return []
    if idf is None:
        terms, df = np.unique(np.concatenate([np.unique(h) for _, h in given]), return_counts=True)
        idf = dict(zip(terms.tolist(), np.log(1 + (len(given) - df + 0.5) / (df + 0.5)).tolist()))
        mean = sum(len(h) for _, h in given) / len(given)
    by: dict[int, list] = {}
    for i, h in given:
        by.setdefault(max(16, 1 << (len(h) - 1).bit_length()), []).append((i, h))
    return [Index(by[k], idf, mean) for k in sorted(by)]


def passages(first: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs of `half` words, and row, first run and last run of the windows of two neighbouring runs."""
    lengths = np.diff(first)
    runs = -(-lengths // half)
    before = np.cumsum(runs) - runs
    start = np.repeat(first[:-1] - before * half, runs) + np.arange(runs.sum()) * half
    many = np.maximum(runs - 1, runs > 0)
    row = np.repeat(np.arange(len(lengths)), many)
    a = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + before[row]
    return start, row, a, np.minimum(a + 1, before[row] + runs[row] - 1)


def search_rows(index: list[Index], h: np.ndarray, first: np.ndarray) -> list[dict[int, dict]]:
    """For each row the items found in it, by item id, with their best figures."""
    out: list[dict[int, dict]] = [{} for _ in range(len(first) - 1)]
    for ix in index:
        if not len(h):
            break
        place = np.searchsorted(ix.terms, h)
        place[place == len(ix.terms)] = 0
        known = ix.terms[place] == h
        place[~known] = len(ix.terms)
        start, row, a, b = passages(first, ix.longest)
        bound = np.add.reduceat(ix.block_most[place], start, axis=0)
        bound = (bound[a] + np.where((a < b)[:, None], bound[b], 0)).max(axis=1)
        ends = np.append(start[1:], len(h))
        for p in np.flatnonzero(bound >= THRESHOLD - 1e-4):
            s, e = start[a[p]], ends[b[p]]
            terms = np.unique(place[s:e][known[s:e]])
            if ix.block_most[terms].sum(axis=0).max(initial=0) < THRESHOLD - 1e-4:
                continue
            if found := ix.search(terms.tolist(), THRESHOLD):
                grams = np.concatenate([W.grams(h[s:e], n) for n in (1, 2, 3)])
                for item, score in found:
                    q, an = ix.overlap(item, grams)
                    if q >= QUESTION and an >= ANSWER:
                        old = out[row[p]].get(ix.ids[item])
                        if not old or old["score"] < score:
                            out[row[p]][ix.ids[item]] = {"item_id": ix.ids[item], "score": score, "question_overlap": q, "answer_overlap": an}
    return out


def _built(items: DataFrame, terms: DataFrame, n: int, mean: float) -> DataFrame:
    """block and its indexes, pickled; items: item_id, text, block; terms: block, term, df."""

    def build(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        df = known["df"].to_numpy()
        idf = dict(zip(known["term"].to_numpy().view(np.uint64).tolist(), np.log(1 + (n - df + 0.5) / (df + 0.5)).tolist()))
        frame = frame.sort_values(["item_id", "text"])
        made = indexes(list(zip(frame["item_id"].tolist(), frame["text"].tolist())), idf, mean) if len(frame) else []
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])] if made else [], "index": [pickle.dumps(made)] if made else []})

    return items.groupBy("block").cogroup(terms.groupBy("block")).applyInPandas(build, "block long, index binary")


def _add_hits(docs: DataFrame, index: list[Index]) -> DataFrame:
    """docs with the hits of one block added to its column `hits`."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(index)
    last = docs.columns.index("hits")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in W.slices(b.column(at), 1 << 18):
                h, first = words(data, offsets)
                part = b.slice(lo, hi - lo)
                before = part.column(last).to_pylist()
                rows = [[*(x or []), *[y[i] for i in sorted(y)]] for x, y in zip(before, search_rows(shared.value, h, first))]
                columns = list(part.columns)
                columns[last] = pa.array(rows, kind)
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(found, docs.schema)


def _statistics(items: DataFrame) -> tuple[DataFrame, int, float]:
    """block, term, df: the terms of each block with their document frequency in all items; how many items have words; their mean length.

    items: text, block.
    """
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in W.slices(b.column(0)):
                h, first = words(data, offsets)
                rows = [np.unique(h[x:y]).view(np.int64) for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["block", "n", "terms"])

    held = written(items.select("text", "block").mapInArrow(terms, "block long, n long, terms array<long>").where("n > 0"), "items")
    size = held.agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    pairs = held.select("block", F.explode("terms").alias("term")).groupBy("block", "term").agg(F.count("*").alias("c"))
    df = pairs.groupBy("term").agg(F.sum("c").alias("df"))
    return written(pairs.join(df, "term").select("block", "term", "df"), "terms"), size["items"], size["mean"]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with a column `hits`: the test items that each text holds (a column of that name is replaced)."""
    out = docs.withColumn("hits", F.array().cast(f"array<{HIT}>"))
    out = out.to(T.StructType([T.StructField(f.name, T._parse_datatype_string(f"array<{HIT}>") if f.name == "hits" else f.dataType, True) for f in out.schema.fields]))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    blocks = -(-items.count() // BLOCK_ITEMS)
    if not blocks:
        return out
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("long"))
    terms, n, mean = _statistics(items)
    if not n:
        return out
    built = written(_built(items, terms, n, mean), "index")
    for k in range(blocks):
        for row in built.where(F.col("block") == k).collect():  # one, or none where no item of the block has words
            out = _add_hits(out, pickle.loads(row["index"]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document id and test item found in it: doc_id, item_id, score, question_overlap, answer_overlap."""
    found = hits(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark)
    rows = found.select("doc_id", F.explode("hits").alias("x")).select("doc_id", "x.*")
    return rows.groupBy("doc_id", "item_id").agg(*[F.round(F.max(c), 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no test item is found, with their columns."""
    own = {"hits": "_fl_hits"} if "hits" in docs.columns else {}
    found = hits(docs.withColumnsRenamed(own), benchmark).where(F.size("hits") == 0).drop("hits")
    return found.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
