"""SentencePiece encoding and decoding of merge-type (BPE) models, without running the merges over the text.

Merging a text's characters by score gives the one sequence of pieces in which every two neighbours, joined and merged
anew, come apart at the same place. So a text is encoded from left to right: an Aho-Corasick automaton finds the pieces
that begin at each place; the longest is tried first, and taken if it is compatible with the piece before it; where none
is, the place is marked in a bitfield of failed positions, the piece before is given back, and the next shorter one is
tried there. Answers of the compatibility check, which merges the two pieces' characters anew, are kept.

No piece of a model holds certain pairs of neighbouring characters (in the usual ones, a word's last character and the
mark of a space), so no merge crosses them: texts are cut there, and what a repeated segment gave is kept. Both memories
are emptied at a fixed size. Rows are handled where they lie; there is no shuffle.

Nulls: a null text counts as an empty one, with no ids; other columns of a row are not read, doc_id is passed on whatever
it is. Characters that the model lacks become their UTF-8 bytes' pieces; a model without byte pieces is refused. Repeated
rows count each, empty tables give empty results, extra columns are ignored. A very long text is handled alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments (of at most LONGEST characters) and pairs whose answers are kept.
KEPT, LONGEST = 250_000, 48
#: Characters of texts that are handled at once.
SLICE_CHARS = 1 << 20


def _cuts(inner: set[tuple[str, str]]) -> re.Pattern:
    """A pattern of segments that no piece reaches out of; inner: the pairs of neighbours that pieces hold.

    Space marks, then signs that no letter is ever followed by within a piece, then the rest; characters that no piece
    of several holds stand alone.
    """
    joined = {c for pair in inner for c in pair}
    if any(b == "▁" != a for a, b in inner):
        return re.compile("(?s:.+)")
    letters = {c for c in joined if c.isalpha()}
    while more := {b for a, b in inner if a in letters} - letters - {"▁"}:
        letters |= more
    w, p = ("".join(map(re.escape, sorted(x - {"▁"}))) for x in (letters, joined - letters))
    return re.compile(f"(?s:▁*[{p or w}]*[{w or p}]+|▁*[{p or w}]+|▁+|.)" if joined else "(?s:.)")


class Encoder:
    """One model, made ready for encoding."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) < 256 or any(sp.is_unused(i) for i in plain):
            raise ValueError("a merge-type model with byte pieces and without unused ones is needed")
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.found.add_word(p, p)
        self.found.make_automaton()
        #: The longest piece that a piece begins with, beside itself; characters have none.
        self.shorter = {p: next(p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in self.ids) for p in self.ids if len(p) > 1}
        inner = {pair for p in self.ids for pair in zip(p, p[1:])}
        self.cut = _cuts(inner)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.segments: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str, seam: int = 0) -> list[str] | None:
        """The characters of a short text, merged by score, of equal ones the leftmost first; None once one crosses the seam."""
        parts, rank, none = list(text), self.rank.get, math.inf
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (r := min(ranks)) < none:
            k = ranks.index(r)
            if k + 1 == seam:
                return None
            seam -= k + 1 < seam
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether pieces a and b stay as they are when their characters are merged anew; a may be empty."""
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        known = self.pairs[a, b] = self.merged(a + b, len(a)) == ([a, b] if a else [b])
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalized text."""
        longest = list(text)  # every character stands for itself, known or not
        for last, piece in self.found.iter(text):
            longest[last + 1 - len(piece)] = piece  # by end, so the longest comes last
        n, known, shorter = len(text), self.pairs.get, self.shorter.get
        failed, at, out, before = 0, 0, [], ""
        while at < n:
            piece = longest[at]
            while True:
                end = at + len(piece)
                if not (failed and failed >> end & 1) and ((ok := known((before, piece))) or ok is None and self.compatible(before, piece)):
                    break
                while not (piece := shorter(piece)):
                    # nothing fits here after the piece before; that one gives way to what is shorter
                    failed |= 1 << at
                    piece = out.pop()
                    at -= len(piece)
                before = out[-1] if out else ""
            out.append(piece)
            at, before = end, piece
        return out

    def segment(self, text: str) -> tuple[int, ...]:
        """The ids of a segment."""
        out: list[int] = []
        for p in self.pieces(text):
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in p.encode()]
        if len(text) <= LONGEST:
            if len(self.segments) >= KEPT:
                self.segments.clear()
            self.segments[text] = tuple(out)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the model normalizes it."""
        known = self.segments.get
        parts = self.cut.findall(self.library.normalize(text))
        return list(chain.from_iterable(known(s) or self.segment(s) for s in parts))


@cache
def encoder(model: bytes) -> Encoder:
    """One encoder a Python worker, which keeps its memories from batch to batch."""
    return Encoder(model)


def parts_of(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters; a longer text makes a range of its own."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text that they decode to, for doc_id and text of `docs`. The model's file is read once, here."""
    with open(model_path, "rb") as f:
        model = f.read()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for lo, hi in parts_of(texts):
                ids = [own.encode(t) for t in texts[lo:hi]]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists, pa.array(own.library.decode(ids, num_threads=1), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(coded, "doc_id long, ids array<int>, decoded string")
