"""Removal of repeated word windows with compressed FM-indexes over shards.

A window is WINDOW consecutive words. Each window is known by its minimizer, the least hash of its GRAM-word grams, and
consecutive windows with the same minimizer make one segment, so that equal windows always lie in segments with equal
minimizers. That deals the corpus into shards by content:

1. segments whose minimizer occurs once hold no repeated window;
2. segments that occur twice or more as a whole are repeated windows throughout;
3. the others go to the shard of their minimizer, one copy of each text. A shard builds an FM-index (wavelet matrix
   over the BWT) of its segments and streams them through backward search; the matching statistics give the stretches
   of WINDOW words or more that occur elsewhere too;
4. segments of a minimizer with more than CROWD different texts would not fit a shard: their windows are counted by
   hash, spread over all tasks.

Words are compared by 64-bit hashes. Windows are judged on the input, all copies are removed.

Nulls: a null text has no words; a null doc_id is kept. Rows equal in doc_id and text each count as an occurrence and
come out alike. Texts shorter than a window stay whole. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm import words as W
from formloom.llm.fmindex import FMIndex
from formloom.llm.shared import written

GRAM = 8
#: Words of segments in one shard's index, on average.
SHARD_WORDS = 600_000
#: Different segments of one minimizer that a shard takes.
CROWD = 10_000

_PLACE = (1 << 28) - 1


def segments(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, row, first window's start and number of windows of each segment; starts count from the row's first word."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none.view(W.U), none, none, none
    g = W.grams(h, GRAM)
    key = (g & W.U(~_PLACE & (1 << 64) - 1)) | (np.arange(len(g)) & _PLACE).astype(W.U)
    need, width, low = window - GRAM + 1, 1, key
    while width * 2 <= need:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    row = W.row_of(first)
    at = np.flatnonzero(row[: len(h) - window + 1] == row[window - 1 :])
    if not len(at):
        return none.view(W.U), none, none, none
    place = (low[at] & W.U(_PLACE)).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    start = at[begin]
    return g[place[begin]], row[start], start - first[row[start]], np.diff(np.r_[begin, len(at)])


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words h[start:end]."""
    up, down = W._Powers.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, W.U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return W.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(W.U))


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in W.slices(column):
        s, e, first = W.spans(data, offsets)
        yield lo, hi, W.hashes(data, s, e), first, data, s, e


def _segments(docs: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, first, *_ in _hashed(b.column(1)):
                m, row, start, many = segments(h, first, window)
                if len(m):
                    at = first[row] + start
                    text = range_hash(h, at, at + many + window - 1)
                    keys = b.column(0)[lo:hi].to_numpy()
                    arrays = [m.view(np.int64), text.view(np.int64), keys[row], start.astype(np.int32), many.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["m", "t", "key", "start", "many"])

    return docs.select("key", "text").mapInArrow(cut, "m long, t long, key long, start int, many int")


def _contents(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The words (hashes) of the asked segments: m, t, key, start, many, whole and words."""
    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("m", "t", "start", "many", "whole")).alias("ask"))
    columns = ["m", "t", "start", "many", "whole"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # rows equal in doc_id and text give the same segments again
            for lo, hi, h, first, *_ in _hashed(b.column(1)):
                rows = []
                for k, key, ask in zip(range(hi - lo), b.column(0)[lo:hi].to_pylist(), b.column(2)[lo:hi].to_pylist()):
                    for a in ask:
                        s = first[k] + a["start"]
                        rows.append((a["m"], a["t"], key, a["start"], a["many"], a["whole"], h[s : s + a["many"] + window - 1].tobytes()))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["m", "t", "key", "start", "many", "whole", "words"])

    return docs.select("key", "text").join(wanted, "key").select("key", "text", "ask").mapInArrow(fetch, "m long, t long, key long, start int, many int, whole boolean, words binary")


def search_shard(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """key, first, last (words of the document) of the repeated stretches in the segments of a shard."""
    frame = frame.sort_values(["m", "t", "key", "start"]).drop_duplicates(["m", "t"], ignore_index=True)
    parts = [np.frombuffer(x, W.U) for x in frame["words"]]
    index = FMIndex(np.concatenate(parts), np.array([len(x) for x in parts]))
    piece, lo, hi = index.repeated(np.flatnonzero(~frame["whole"].to_numpy(bool)), window)
    start = frame["start"].to_numpy(np.int64)[piece]
    return pd.DataFrame({"key": frame["key"].to_numpy()[piece], "lo": start + lo, "hi": start + hi})


def _counted(crowd: DataFrame, window: int) -> DataFrame:
    """The same for segments of crowded minimizers, by counting the hashes of all their windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, start, many, text in zip(*[b.column(k).to_pylist() for k in range(4)]):
                h = np.frombuffer(text, W.U)
                at = np.arange(many)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, key)), pa.array(start + at), pa.array(range_hash(h, at, at + window).view(np.int64))], ["key", "lo", "w"])

    every = crowd.select("key", "start", "many", "words").mapInArrow(windows, "key long, lo long, w long")
    twice = every.groupBy("w").agg(F.count("*").alias("c")).where("c > 1").select("w")
    return every.join(twice, "w").select("key", "lo", (F.col("lo") + window).alias("hi"))


def repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """key and spans (array of lo, hi: words lo to hi - 1) of the repeated windows; docs: key, text."""
    cut = written(_segments(docs, window), "segments")
    often = cut.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m")
    cut = written(cut.join(often, "m"), "candidates")
    texts = cut.groupBy("m", "t").agg(F.count("*").alias("c"), F.min(F.struct("key", "start", "many")).alias("at"))
    texts = written(texts.select("m", "t", (F.col("c") > 1).alias("whole"), "at.*"), "texts")
    whole = cut.join(texts.where("whole").select("m", "t"), ["m", "t"]).select("key", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("many") + window - 1).cast("long").alias("hi"))
    several = texts.groupBy("m").agg(F.count("*").alias("texts"), F.bool_and("whole").alias("done")).where("texts > 1 and not done")
    asked = texts.join(several.select("m", "texts"), "m")
    crowded = several.where(F.col("texts") > CROWD).select("m")
    held = written(_contents(docs, asked.select("m", "t", "key", "start", "many", "whole"), window), "contents")
    total = held.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_WORDS))
    spans = whole
    if total:
        fits, crowd = held.join(crowded, "m", "left_anti"), held.join(crowded, "m", "left_semi").dropDuplicates(["m", "t"])
        found = fits.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))).groupBy("shard").applyInPandas(lambda f: search_shard(f, window), "key long, lo long, hi long")
        spans = spans.unionByName(found).unionByName(_counted(crowd, window))
    return written(spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, text without its repeated windows (kept words joined by one blank), n_words, n_removed and kept_sha256."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeats(keyed, window)
    names = ["doc_id", "text", "n_words", "n_removed", "kept_sha256"]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in W.slices(b.column(1)):
                s, e, first = W.spans(data, offsets)
                texts, total, removed, digests = [], [], [], []
                for k, found in enumerate(b.column(2)[lo:hi].to_pylist()):
                    edge = np.zeros(first[k + 1] - first[k] + 1, np.int64)
                    for x in found or ():
                        edge[x["lo"]] += 1
                        edge[x["hi"]] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    at = offsets[k]
                    if stay.all():
                        left = b" ".join(raw.translate(_SPACES).split())
                    else:
                        pick = np.flatnonzero(stay) + first[k]
                        left = b" ".join([raw[x:y] for x, y in zip((s[pick] - at).tolist(), (e[pick] - at).tolist())])
                    texts.append(left)
                    total.append(len(stay))
                    removed.append(len(stay) - int(stay.sum()))
                    digests.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names)

    joined = keyed.join(spans, "key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(kept, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")


#: bytes.split() also splits at the other control characters that it takes for white space; only these count here.
_SPACES = bytes(0x20 if c in (0x20, *range(0x09, 0x0E)) else c for c in range(256))
