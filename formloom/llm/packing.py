"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Pieces are dealt by a hash into groups of bounded size. A group starts from best fit (longest first), then a local
search works on its underfull bins: it moves a document, exchanges one for one or two for one, whenever that raises
the sum of squared fills, and so empties the least filled bins. Bins that stay underfull in a group go on to the
next round, where the loose pieces of many groups meet; rounds end when one group held all loose pieces or when a
round no longer halves them.

Nulls: a null text counts as empty, a null doc_id is kept as null. An empty text is one piece that holds only the end
token. Repeated rows are packed as often as they come. An empty table gives an empty result. Extra columns of the
input are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.shared import written

#: Pieces dealt to one group of the packing, on average.
GROUP = 8192
#: Bins at least this full are not opened again in later rounds.
CLOSED = 0.995
#: Parts of texts, and runs of letters, kept with their ids by each Python worker.
CACHE_WORDS = 300_000
#: The set-up of a tokenizer file (as JSON) that _SPLIT and lower() reproduce on plain words.
_FAST = {
    "normalizer": json.dumps({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}),
    "pre_tokenizer": json.dumps({"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]}),
}
_PLAIN = re.compile("[ \\n!-~À-ÖØ-öø-ÿ]*").fullmatch
_SPLIT = re.compile("[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \\na-zß-öø-ÿ0-9]+").findall


class WordIds:
    """Ids of texts by a public tokenizer, word by word with a bounded memory of words met before.

    The tokenizer drops white space and never joins text across a blank or a line break, so that the ids of a text are
    those of its blank-separated parts, one after the other. Where the tokenizer file lower-cases and splits in the way
    of _FAST, parts of plain Latin letters, digits and punctuation go to its model piece by piece, without the costly
    general normalisation; all other parts, and all parts under other files, are encoded by the whole tokenizer.
    """

    _kept: dict[str, "WordIds"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        set_up = json.loads(self.tokenizer.to_str())
        self.fast = all(json.dumps(set_up[k]) == v for k, v in _FAST.items()) and all("<|" in x["content"] for x in set_up["added_tokens"])
        self.model = self.tokenizer.model
        # the byte-level alphabet: each byte of a letter outside ASCII stands as one printable character
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.shown = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.four = [x.to_bytes(4, "little") for x in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.runs = _Runs(self)
        self.parts = _Parts(self)

    @classmethod
    def of(cls, path: str) -> "WordIds":
        """One for each Python worker and path."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def run(self, run: str) -> bytes:
        four = self.four
        return b"".join([four[x.id] for x in self.model.tokenize(run if run.isascii() else run.translate(self.shown))])

    def part(self, part: str) -> bytes:
        if self.fast and _PLAIN(part) and "<|" not in part:
            return b"".join(map(self.runs.__getitem__, _SPLIT(part.lower())))
        return b"".join([self.four[x] for x in self.tokenizer.encode(part, add_special_tokens=False).ids])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.fast and _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.runs.__getitem__, _SPLIT(text.lower())))
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" ")))


class _Runs(dict):
    """Ids by run of letters or of other characters; forgets all when it is full."""

    def __init__(self, ids: WordIds):
        self.make = ids.run

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[key] = found = self.make(key)
        return found


class _Parts(_Runs):
    """Ids by blank-separated part of a text."""

    def __init__(self, ids: WordIds):
        self.make = ids.part


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most `capacity` ids of every text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer_path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(names), 1000):
                rows = []
                for name, text in zip(names[lo : lo + 1000], texts[lo : lo + 1000].to_pylist()):
                    ids = words.encode(text or "") + end
                    for k in range(0, len(ids), step):
                        part = ids[k : k + step]
                        rows.append((name, k // step, k // 4, len(part) // 4, zlib.crc32(part), *([part] * with_ids)))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                heads = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], heads[: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, by best fit with the longest first."""
    bins = np.empty(len(lengths), np.int64)
    free: list[int] = []  # distinct free sizes of open bins, ascending
    having: dict[int, list[int]] = {}
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        k = bisect.bisect_left(free, need)
        if k == len(free):
            b, left = count, capacity - need
            count += 1
        else:
            size = free[k]
            b = having[size].pop()
            if not having[size]:
                del having[size], free[k]
            left = size - need
        bins[i] = b
        if left:
            if left not in having:
                bisect.insort(free, left)
                having[left] = []
            having[left].append(b)
    return bins


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, steps: int = 4000) -> np.ndarray:
    """Better bins: documents move, or are exchanged one for one or two for one, out of the least filled bin.

    Each step raises the sum of squared fills, so the search ends; it stops early when no bin fewer is possible, or
    after `steps` steps (a bound on effort: all documents stay packed).
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    least = -(-int(lengths.sum()) // capacity)
    stuck: set[int] = set()
    while steps > 0 and (fill > 0).sum() > least:
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
        donors = [b for b in open_bins[np.argsort(fill[open_bins], kind="stable")] if b not in stuck]
        if not donors:
            break
        a, moved = donors[0], False
        others = open_bins[open_bins != a]
        inside = np.flatnonzero(np.isin(bins, others))
        mine = np.flatnonzero(bins == a)
        while len(mine) and steps > 0:
            steps -= 1
            best, gain = None, 0
            room = capacity - fill
            one = [(int(i),) for i in mine[np.unique(lengths[mine], return_index=True)[1]]]
            few = mine[np.unique(lengths[mine], return_index=True)[1]][-24:]
            two = [(int(i), int(j)) for x, i in enumerate(few) for j in few[x + 1 :]]
            for group in one:  # move one
                size = int(lengths[list(group)].sum())
                fits = others[(room[others] >= size)]
                if len(fits):
                    b = fits[np.argmax(fill[fits])]
                    if (g := 2 * size * int(fill[b] + size - fill[a])) > gain:
                        best, gain = (group, None, int(b)), g
            if len(inside):
                ls, rs, fs = lengths[inside], room[bins[inside]], fill[bins[inside]]
                for group in one + two:  # exchange one or two for one
                    d = int(lengths[list(group)].sum()) - ls
                    ok = (d > 0) & (d <= rs)
                    g = np.where(ok, 2 * d * (fs + d - fill[a]), 0)
                    k = int(np.argmax(g))
                    if g[k] > gain:
                        best, gain = (group, int(inside[k]), int(bins[inside[k]])), int(g[k])
            if best is None:
                break
            group, back, b = best
            size = int(lengths[list(group)].sum()) - (int(lengths[back]) if back is not None else 0)
            bins[list(group)] = b
            if back is not None:
                bins[back] = a
            fill[b] += size
            fill[a] -= size
            moved = True
            mine = np.flatnonzero(bins == a)
            inside = np.flatnonzero(np.isin(bins, others))
        if moved:
            stuck.clear()
        if fill[a]:
            stuck.add(int(a))
    return bins


def _pack_group(frame: pd.DataFrame, capacity: int, number: int) -> pd.DataFrame:
    lengths = frame["length"].to_numpy(np.int64)
    order = np.lexsort((frame["ids_crc32"], frame["piece"], frame["doc_id"], frame["no_id"], -lengths))
    frame, lengths = frame.iloc[order], lengths[order]
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    by = np.argsort(bins, kind="stable")
    frame, lengths, bins = frame.iloc[by].copy(), lengths[by], bins[by]
    begins = np.cumsum(lengths) - lengths
    first = np.r_[True, bins[1:] != bins[:-1]] if len(bins) else np.zeros(0, bool)
    frame["offset"] = begins - np.maximum.accumulate(np.where(first, begins, 0))
    frame["sequence_id"] = (np.int64(number) << 56) + (frame["grp"].to_numpy(np.int64) << 24) + bins
    frame["fill"] = np.bincount(bins, weights=lengths).astype(np.int64)[bins] if len(bins) else 0
    return frame


def pack(parts: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """The rows of pieces() with sequence_id and offset; see the module's text for the method."""
    # null ids travel as a flag: a null among longs would turn a group's ids into floats
    columns = ["doc_id", "no_id", "piece", "start", "length", "ids_crc32"]
    parts = parts.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    parts = written(parts.select(*columns), "pieces")
    loose, done, number = parts.where(F.col("length") < capacity), [], 0
    whole = parts.where(F.col("length") >= capacity)
    done.append(whole.withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(1 << 61), "offset": F.lit(0).cast("long")}))
    schema = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, grp long, offset long, sequence_id long, fill long"
    count, before = loose.count(), None
    while count:
        groups = -(-count // group)
        dealt = loose.select(*columns, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("grp"))
        this = number
        packed = dealt.groupBy("grp").applyInPandas(lambda f: _pack_group(f, capacity, this), schema)
        packed = written(packed, "packed")
        last = groups == 1 or before is not None and count > before / 2
        closed = packed if last else packed.where(F.col("fill") >= int(CLOSED * capacity))
        done.append(closed.select(*columns, "sequence_id", "offset"))
        if last:
            break
        loose = packed.where(F.col("fill") < int(CLOSED * capacity))
        before, count, number = count, loose.count(), number + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
