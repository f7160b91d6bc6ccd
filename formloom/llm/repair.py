"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

The repaired roles read ``(s?(ua)+)?`` (system, user, assistant by their first letter). Rows are kept, given another role,
deleted or inserted at a cost each, and the cheapest repair is the lightest derivation of a weighted hypergraph: an item
"rows up to i are repaired, and the roles so far lead to state q" follows from the item before it and the item of row i,
or from itself by an insertion. An agenda pops items by (cost, audit), where the audit spells the edits so far; both grow
along every deduction, so that an item's weight is final when it is popped, and the search ends with the goal.

Rows are ordered by range partitions and cut into chunks of bounded size, so a conversation may be of any length: a
chunk's agenda gives the lightest way from each state at its start to each at its end, a stream over the chunks of a
conversation chooses among them, and the edits are applied chunk by chunk. Rows that were already said are found by an
aggregate and a join, equal rows of one turn are counted before anything is sorted. Only the digest of a conversation
needs its chunks in order in one task, as a stream.

Nulls: a null role or text counts as one space, an empty role is none that may stay, null turns come first, a null
conv_id is a conversation of its own. Ties in turn go by the first 32 characters of the role, the first 64 of the text,
then role and text. Equal rows of one turn count each; all but the first are duplicates. A conversation without rows has
zeros and empty texts. Empty tables give empty results, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.shared import written

#: Rows and characters of a chunk, at most (one longer text makes a chunk of its own).
CHUNK_ROWS, CHUNK_CHARS = 256, 1 << 20
#: What the edits cost, and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The roles' automaton: state 0 at the start, 1 after a system turn, 2 after a user's, 3 after an assistant's.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
NAMES = {"u": "user", "a": "assistant"}

Weight = tuple[int, str]
#: A row for the repair: its role's initial, "" if it has to go; whether it is cut off; how many equal rows it stands for.
Row = tuple[str, bool, int]


def lightest(axioms: Iterable[tuple[Weight, Hashable]], deduce: Callable[[Hashable, dict], Iterable[tuple[Weight, Hashable]]], goals: tuple = ()) -> dict:
    """Final weights of the items that an agenda pops, up to the first goal.

    deduce(item, final) gives the heads, with their weights, of the hyperedges that `item` completes: those whose other
    tails are in `final`. No head may weigh less than a tail.
    """
    agenda, final = list(axioms), {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if item in goals:
            break
        for head in deduce(item, final):
            if head[1] not in final:
                heapq.heappush(agenda, head)
    return final


def _edits(row: Row, q: int) -> list[tuple[int, str, int]]:
    """(cost, letters, state after) of what can be done with a row in state q."""
    initial, cut, n = row
    out = [(DELETE * n, "D" * n, q)]
    if initial:
        more = TRUNCATED * cut
        if (q, initial) in STEP:
            out.append((more, "K", STEP[q, initial]))
        out += [(REROLE + more, "R", STEP[q, s]) for s in NAMES if (q, s) in STEP]
    return out


def _ways(rows: tuple[Row, ...], q: int, goals: tuple) -> dict:
    def after(i: int, q: int, weight: Weight) -> Iterator[tuple[Weight, Hashable]]:
        cost, audit = weight
        for c, letters, r in _edits(rows[i], q):
            yield (cost + c, audit + letters), ("at", i + 1, r)

    def deduce(item: tuple, final: dict) -> Iterator[tuple[Weight, Hashable]]:
        kind, i, q = item
        if kind == "row":
            for r in range(4):
                if (before := final.get(("at", i, r))) is not None:
                    yield from after(i, r, before)
            return
        cost, audit = final[item]
        if i < len(rows) and ("row", i, 0) in final:
            yield from after(i, q, (cost, audit))
        for s in NAMES:
            if (q, s) in STEP:
                yield (cost + INSERT, audit + "I"), ("at", i, STEP[q, s])

    axioms = [((0, ""), ("row", i, 0)) for i in range(len(rows))]
    return lightest([*axioms, ((0, ""), ("at", 0, q))], deduce, goals)


@lru_cache(1 << 14)
def repaired(rows: tuple[Row, ...]) -> tuple[int, Weight]:
    """The state at the end and the weight of the lightest repair of a whole conversation."""
    goals = tuple(("at", len(rows), q) for q in ACCEPT)
    found = _ways(rows, 0, goals)
    return next((g[2], found[g]) for g in goals if g in found)


@lru_cache(1 << 12)
def spans(rows: tuple[Row, ...]) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, audit) of the lightest ways through some rows, for all states that can meet."""
    out = []
    for q in range(4):
        found = _ways(rows, q, ())
        out += [(q, r, *found["at", len(rows), r]) for r in range(4) if ("at", len(rows), r) in found]
    return tuple(out)


def edited(rows: Iterable[tuple[str, str, int]], q: int, audit: str) -> list[tuple[str, str]]:
    """(role, text) that an audit leaves of rows (role, text, copies), from state q on."""
    out, given = [], ((role, text) for role, text, n in rows for _ in range(n))
    for letter in audit:
        due = "a" if q == 2 else "u"
        role, text = next(given) if letter != "I" else (NAMES[due], "")
        if letter == "D":
            continue
        if letter == "R":
            role = NAMES[due]
        out.append((role, text))
        q = STEP[q, role[:1]]
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults by crc32 of ``conv_id:turn``: rows dropped, emptied, cut, repeated, renamed."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), given("role").alias("role"), given("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """Each distinct row of a conversation once, with its copies and its fault.

    conv (the conversation as text), conv_id, has_turn, at (the turn), role, text, n (copies), blank, said (already said by
    an earlier row), cut (truncated; neither blank nor said).
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(given("conv_id").alias("conv"), F.col("conv_id").cast("long"), F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"), given("role").alias("role"), given("text").alias("text"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    rows = rows.withColumn("what", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = rows.groupBy("conv", "what").agg(F.min(F.struct("has_turn", "at")).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    known = rows.join(first, ["conv", "what"]).withColumn("blank", bare == "").withColumn("said", F.struct("has_turn", "at") != F.col("first"))
    return known.withColumn("cut", ~F.col("blank") & ~F.col("said") & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).drop("what", "first")


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_CHUNK = "part int, seq long, conv string, conv_id long, roles array<string>, texts array<string>, copies array<long>, spans array<struct<q:int,r:int,cost:long,audit:string>>, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, n_turns long, first_initial string, last_initial string"
_SPANS = pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


@dataclass
class Chunk:
    """Consecutive rows of one conversation in one partition."""

    conv: str
    conv_id: int | None
    begins: bool  # whether the conversation is known to begin here
    rows: list[Row] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [0] * len(_COUNTS))
    turns: list[int | None] = field(default_factory=lambda: [None, None, 0])  # first, last, how many
    size: int = 0

    def add(self, has_turn: bool, at: int, role: str, text: str, n: int, blank: bool, said: bool, cut: bool) -> None:
        initial = role[:1]
        if self.roles:
            self.counts[3] += not _legal(self.roles[-1][:1], initial)
        self.counts[3] += n - 1
        self.counts[0] += n * blank
        self.counts[1] += 0 if blank else n if said else n - 1
        self.counts[2] += cut
        if has_turn:
            first, last, k = self.turns
            self.turns = [at if first is None else first, at, k + (last != at or first is None)]
        if blank or said:
            self.rows.append(("", False, n))
        else:
            self.rows.append((initial if initial in "sua" and initial else "?", cut, 1))
            if n > 1:
                self.rows.append(("", False, n - 1))
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(n)
        self.size += len(text)

    def row(self, part: int, seq: int, ends: bool) -> tuple:
        rows = tuple(self.rows)
        if self.begins and ends:
            r, (cost, audit) = repaired(rows)
            found = [(0, r, cost, audit)]
        else:
            found = spans(rows)
        ways = [{"q": q, "r": r, "cost": c, "audit": a} for q, r, c, a in found]
        return (part, seq, self.conv, self.conv_id, self.roles, self.texts, self.copies, ways, *self.counts, *self.turns, self.roles[0][:1], self.roles[-1][:1])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [_ARROW.get(x.split()[1], _SPANS) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def chunks(rows: DataFrame) -> DataFrame:
    """The rows of faults() in order, as chunks; (part, seq) orders those of a conversation."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seq, out, size = TaskContext.get().partitionId(), None, 0, [], 0
        for b in batches:
            for conv, conv_id, *rest in zip(*[c.to_pylist() for c in b.columns]):
                if now is not None and (conv != now.conv or len(now.roles) >= CHUNK_ROWS or now.size >= CHUNK_CHARS):
                    out.append(now.row(part, seq, conv != now.conv))
                    size += now.size
                    # the first conversation of a partition may have begun in the one before
                    now, seq = Chunk(conv, conv_id, conv != now.conv), seq + 1
                elif now is None:
                    now = Chunk(conv, conv_id, False)
                now.add(*rest)
                if len(out) >= 500 or size >= CHUNK_CHARS:
                    yield _batch(out, _CHUNK)
                    out, size = [], 0
        if now is not None:
            yield _batch([*out, now.row(part, seq, False)], _CHUNK)

    ties = [F.left("role", F.lit(32)), F.left("text", F.lit(64))]
    dealt = rows.repartitionByRange("conv", "has_turn", "at", *ties).sortWithinPartitions("conv", "has_turn", "at", *ties, "role", "text")
    return dealt.select("conv", "conv_id", "has_turn", "at", "role", "text", "n", "blank", "said", "cut").mapInArrow(cut, _CHUNK)


_RESULT = "conv_id long, key_part int, key_seq long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, choices array<struct<part:int,seq:long,q:int,audit:string>>"
_CHOICES = pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int64()), ("q", pa.int32()), ("audit", pa.string())]))


class _Fold:
    """The chunks of one conversation so far, and the lightest ways to each state after them."""

    def __init__(self, chunk: dict):
        self.conv, self.conv_id, self.key = chunk["conv"], chunk["conv_id"], (chunk["part"], chunk["seq"])
        self.counts, self.first, self.last, self.n_turns, self.initial = [0] * len(_COUNTS), None, None, 0, None
        #: By state: cost, and the chunks' choices; what all of them share is in `settled`.
        self.ways: dict[int, tuple[int, str, list[tuple]]] = {0: (0, "", [])}
        self.settled: list[tuple] = []

    def add(self, c: dict) -> None:
        for k, name in enumerate(_COUNTS):
            self.counts[k] += c[name]
        if self.initial is not None:
            self.counts[3] += not _legal(self.initial, c["first_initial"])
        self.initial = c["last_initial"]
        if c["n_turns"]:
            self.n_turns += c["n_turns"] - (self.last is not None and self.last == c["first_turn"])
            self.first, self.last = c["first_turn"] if self.first is None else self.first, c["last_turn"]
        after: dict[int, tuple[int, str, list[tuple]]] = {}
        for s in c["spans"]:
            if s["q"] in self.ways:
                cost, audit, choices = self.ways[s["q"]]
                cost, audit = cost + s["cost"], audit + s["audit"]
                if s["r"] not in after or (cost, audit) < after[s["r"]][:2]:
                    after[s["r"]] = (cost, audit, [*choices, (c["part"], c["seq"], s["q"], s["audit"])])
        # chunks that all ways treat alike are settled; comparing what comes after them is enough
        alike = len(commonprefix([w[2] for w in after.values()]))
        if alike:
            first = next(iter(after.values()))[2][:alike]
            self.settled += first
            gone = sum(len(x[3]) for x in first)
            after = {r: (cost, audit[gone:], choices[alike:]) for r, (cost, audit, choices) in after.items()}
        self.ways = after

    def row(self) -> tuple:
        cost, audit, choices = min(self.ways[q] for q in ACCEPT if q in self.ways)
        choices = [*self.settled, *choices]
        gaps = self.last - self.first + 1 - self.n_turns if self.n_turns else 0
        return (self.conv_id, *self.key, min(gaps, 2**63 - 1), *self.counts, cost, "".join(x[3] for x in choices), [dict(zip(("part", "seq", "q", "audit"), x)) for x in choices])


def chosen(cut: DataFrame) -> DataFrame:
    """One row per conversation: its counts, the lightest repair, and each chunk's part in it."""
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [_ARROW.get(x.split()[1], _CHOICES) for x in _RESULT.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for b in batches:
            for lo in range(0, len(b), 1000):
                for c in b.slice(lo, 1000).to_pylist():
                    if now is None or c["conv"] != now.conv:
                        if now is not None:
                            out.append(now.row())
                        now = _Fold(c)
                    now.add(c)
                if len(out) >= 1000:
                    yield packed(out)
                    out = []
        if now is not None:
            yield packed([*out, now.row()])

    bare = cut.drop("roles", "texts", "copies")
    return bare.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(fold, _RESULT)


_FIXED = "key_part int, key_seq long, part int, seq long, conv_id long, roles array<string>, texts array<string>"


def applied(cut: DataFrame, results: DataFrame) -> DataFrame:
    """The repaired turns, as lists of roles and texts in chunks; (key_part, key_seq) names the conversation."""

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 64):
                out = []
                for c in b.slice(lo, 64).to_pylist():
                    left = edited(zip(c["roles"], c["texts"], c["copies"]), c["q"], c["audit"])
                    out.append((c["key_part"], c["key_seq"], c["part"], c["seq"], c["conv_id"], [x[0] for x in left], [x[1] for x in left]))
                yield _batch(out, _FIXED)

    steps = results.select("key_part", "key_seq", F.inline("choices"))
    both = cut.select("part", "seq", "conv_id", "roles", "texts", "copies").join(steps, ["part", "seq"])
    return both.select("key_part", "key_seq", "part", "seq", "conv_id", "roles", "texts", "copies", "q", "audit").mapInArrow(fix, _FIXED)


def turns_of(fixed: DataFrame) -> DataFrame:
    """The repaired turns as rows: conv_id, part, seq and place (which order them), role, text."""
    return fixed.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")).select("conv_id", "part", "seq", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


def digests(fixed: DataFrame) -> DataFrame:
    """key_part, key_seq and the SHA-256 of a conversation's repaired ``role:text``, joined by newlines."""
    schema = "key_part int, key_seq long, repaired_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, any_, out = None, None, False, []
        for b in batches:
            for part, seq, roles, texts in zip(*[c.to_pylist() for c in b.columns]):
                if key != (part, seq):
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha, any_ = (part, seq), hashlib.sha256(), False
                for role, text in zip(roles, texts):
                    sha.update(("\n" * any_ + f"{role}:{text}").encode())
                    any_ = True
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if key is not None:
            yield _batch([*out, (*key, sha.hexdigest())], schema)

    dealt = fixed.repartition("key_part", "key_seq").sortWithinPartitions("key_part", "key_seq", "part", "seq")
    return dealt.select("key_part", "key_seq", "roles", "texts").mapInArrow(hashed, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (one row per conversation with rows) and repaired turns (in chunks) of conv_id, turn, role and text."""
    cut = written(chunks(faults(turns)), "repair-chunks")
    results = written(chosen(cut), "repair-results")
    return results, applied(cut, results)


def report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """What was wrong with each of `conversations` (distinct conv_id), the edits, and the repaired turns' digest."""
    results, fixed = repair(turns)
    found = results.drop("choices").join(digests(fixed), ["key_part", "key_seq"]).withColumnRenamed("conv_id", "id_")
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0)) for c in ("gaps", *_COUNTS, "cost")}
    out = conversations.join(found, conversations["conv_id"].eqNullSafe(found["id_"]), "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", *[e.alias(c) for c, e in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
