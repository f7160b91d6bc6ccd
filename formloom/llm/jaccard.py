"""Exact Jaccard join of word shingles by T-occurrence search, and the groups that its links make.

1. Texts with equal shingle sets become one representative.
2. Every set gives a prefix in one global order of all shingles: shingles met in many prefixes last, else by hash. Two
   sets that reach the threshold share at least 1 + n // SLACK shingles of their prefixes (n: the smaller size), and one
   of them among the leading ones, which are as many as the threshold alone asks for. Prefix shingles that no other set
   of a fitting size has are dropped, and so are sets with too few left or with no leading one.
3. The remaining sets are dealt into blocks by size class and by their first shared shingle; a family larger than a
   block is dealt over several. In each block an inverted index over whole sets answers T-occurrence queries with DivideSkip: the longest
   lists of a query are set aside, the shorter ones are merged, and candidates of the merge are looked up in the long
   ones by binary search. Sizes then decide exactly.
4. Links between blocks are found the same way: a set becomes a query to each other block in which enough of its
   prefix shingles occur in sets of a larger group (ties by number) than its own. A link joins two groups whichever of
   them asks, so the members of a large family need not ask for every stray set near it. First only a few sets of each
   group are sent; what is still open after that is sent whole, so that no link between different groups is missed.

The order only steers the work; any order gives the same links. Shingles are compared by 64-bit hashes.

Nulls: a null text has no words. A text with fewer words than a shingle has is one shingle; one without words is linked
with nothing. Rows that share a doc_id but not a text are grouped by their texts, and repeated rows come out each. A null
doc_id gets the group of its text's other documents, or null; texts that only rows without an id have are linked with none. Empty tables give empty results. Extra columns are
ignored by groups() and kept by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm import words as W
from formloom.llm.bitmaps import bitmap, passes
from formloom.llm.components import components
from formloom.llm.shared import written

#: Prefixes hold n // SLACK shingles more than the threshold alone asks for.
SLACK = 20
#: A shingle of more prefixes than this comes last in the order (more, where that would mark over MARKED shingles).
FREQUENT, MARKED = 6, 1 << 20
#: Sets and shingles (4 MB) in one block of the index, at most on average, and queries that one task puts to a block.
BLOCK, SHINGLES, QUERIES = 4096, 1 << 19, 2048
#: Sets of a group that are sent to other blocks before all are, the shingles by which those blocks are found, and how
#: many blocks each is sent to. These only join large groups early; what they leave is sent without such bounds.
FIRST_SENT, FIRST_SHINGLES, FIRST_BLOCKS = 3, 12, 3


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's word hashes."""
    if not len(h):
        return np.zeros(0, W.U)
    return np.unique(W.grams(h, size) if len(h) >= size else W.grams(h, len(h)) + W.U(len(h)))


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n that go into its prefix."""
    return n - -(-n * percent // 100) + 1 + n // SLACK


def digest(s: np.ndarray) -> int:
    """A number for each set of shingles: texts with equal sets have equal ones."""
    d1 = np.add.reduce(W.mix(s), initial=W.U(0), keepdims=True)
    d2 = np.add.reduce(W.mix(s + W.U(0x632BE59BD9B4E019)), initial=W.U(0), keepdims=True)
    return int(W.mix(d1 + W.mix(d2)).view(np.int64)[0])


def _texts(b: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo, _, data, offsets in W.slices(b.column(column)):
        data = W.lower(data)
        s, e, first = W.spans(data, offsets)
        h = W.hashes(data, s, e)
        for k in range(len(first) - 1):
            yield lo + k, shingles(h[first[k] : first[k + 1]], size)


def _prefix_hashes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The prefix shingles of all texts by hash alone, once per task batch with their counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s[: prefix_length(len(s), percent)] for _, s in _texts(b, 0, size) if len(s)]
            if found:
                tokens, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "c"])

    return docs.select("text").mapInArrow(counted, "token long, c long")


def _frequent(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """Shingles of many prefixes, at most MARKED."""
    counts = _prefix_hashes(docs, size, percent).groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") > FREQUENT)
    counts = written(counts, "frequent")
    total = counts.agg(F.sum("c")).first()[0] or 0
    tokens = [r.token for r in counts.where(F.col("c") > total // MARKED).select("token").toLocalIterator()]
    return np.sort(np.array(tokens, np.int64).view(W.U))


def _prefixes(docs: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, rep (the set's digest) and prefix of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for b in batches:
            n, rep, prefix = [], [], []
            for _, s in _texts(b, 1, size):
                n.append(len(s))
                rep.append(digest(s))
                if len(s):
                    p = prefix_length(len(s), percent)
                    if len(late):
                        at = np.searchsorted(late, s)
                        at[at == len(late)] = 0
                        is_late = late[at] == s
                        if is_late[: p + 1].any():
                            s = np.concatenate([s[~is_late], s[is_late]])
                    s = s[:p]
                prefix.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(rep, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "n", "rep", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, n long, rep long, prefix binary")


def _tokens(reps: DataFrame, percent: int) -> DataFrame:
    """(token, rep, leading) of all prefixes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                arrays = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in arrays])
                leading = [np.arange(len(x)) < prefix_length(n, percent) - n // SLACK for x, n in zip(arrays, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(arrays)), pa.array(ids), pa.array(np.concatenate(leading))], ["token", "rep", "leading"])

    return reps.select("rep", "prefix", "n").mapInArrow(spread, "token long, rep long, leading boolean")


def linked(a: int, na: int, nb: int, percent: int) -> bool:
    """Whether two sets of sizes na and nb with a common shingles reach the threshold."""
    return 100 * a >= percent * (na + nb - a)


def divide_skip(lists: list[np.ndarray], t: int, mu: float = 0.0085) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least t of the sorted lists, and in how many each is.

    The longest lists are set aside; the others are merged in one sorted run (the array form of a heap merge); those
    in enough of them are looked up in the long ones by binary search.
    """
    lists = sorted(lists, key=len)
    aside = min(t - 1, int(t / (mu * math.log2(max(2, len(lists[-1]))) + 1)), len(lists) - 1)
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found, counts = np.unique(np.concatenate(short), return_counts=True)
    keep = counts >= t - aside
    found, counts = found[keep], counts[keep]
    for k, x in enumerate(long):
        if not len(found):
            break
        at = np.searchsorted(x, found)
        at[at == len(x)] = 0
        counts += x[at] == found
        keep = counts >= t - (len(long) - 1 - k)
        found, counts = found[keep], counts[keep]
    return found, counts


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def search_block(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges (a, b) that join the groups linked by queries of a block; columns rep, comp, member, query and shingles."""
    frame = frame.sort_values(["rep", "member"], ascending=[True, False], kind="stable").drop_duplicates("rep", ignore_index=True)
    sets = [np.frombuffer(x, W.U) for x in frame["shingles"]]
    n = np.array([len(x) for x in sets])
    member, query = frame["member"].to_numpy(bool), frame["query"].to_numpy(bool)
    union = _Union(len(sets))
    heads: dict[int, int] = {}
    for k, c in enumerate(frame["comp"].tolist()):
        union.join(heads.setdefault(c, k), k)
    # near copies mostly share their first shingles: one look at what came before joins most of a large family
    leaders: dict[int, int] = {}
    for k, s in enumerate(sets):
        for t in s[:3].tolist():
            o = leaders.setdefault(t, k)
            if o != k and union.root(o) != union.root(k) and 100 * min(n[o], n[k]) >= percent * max(n[o], n[k]):
                if linked(len(np.intersect1d(sets[o], s, assume_unique=True)), int(n[o]), int(n[k]), percent):
                    union.join(o, k)
    comp = np.array([union.root(k) for k in range(len(sets))])
    # only shingles of two groups or more can show another link
    tokens = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    begin = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    many = np.minimum.reduceat(comp[doc], begin) != np.maximum.reduceat(comp[doc], begin)
    size = np.diff(np.r_[begin, len(tokens)])
    keep = np.repeat(many, size)
    doc, number = doc[keep], np.repeat(np.cumsum(many) - 1, size)[keep]
    inside = member[doc]
    lists = np.split(doc[inside], np.searchsorted(number[inside], np.arange(1, many.sum())))
    by = np.argsort(doc, kind="stable")
    of = np.split(number[by], np.searchsorted(doc[by], np.arange(1, len(sets))))
    for k in np.flatnonzero(query):
        t = -(-percent * int(n[k]) // 100)
        mine = [lists[x] for x in of[k] if len(lists[x])] if len(of[k]) >= t else []
        if len(mine) < t:
            continue
        for o, a in zip(*divide_skip(mine, t)):
            if o != k and linked(int(a), int(n[k]), int(n[o]), percent):
                union.join(int(o), int(k))
    reps = frame["rep"].to_numpy()
    root = np.array([union.root(k) for k in range(len(sets))])
    edges = [(int(reps[k]), int(reps[r])) for k, r in enumerate(root) if k != r]
    edges += [(int(r), int(c)) for r, c in zip(reps, frame["comp"]) if r != c]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _active_sets(docs: DataFrame, active: DataFrame, size: int) -> DataFrame:
    """(rep, shingles) of the active sets (doc_id: of one text with this set), and of few other documents.

    A bitmap of the ids keeps most other texts from being shingled once more.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(active.select("doc_id"), active.count()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(passes(bits.value, b.column(0).to_numpy())))
            if len(b):
                found = [s for _, s in _texts(b, 1, size)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["rep", "shingles"])

    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(made, "rep long, shingles binary")


def _size_class(n: Column, percent: int) -> Column:
    """A number that differs by at most one between sets whose sizes allow a link."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else n.cast("int")


def _met(tokens: DataFrame, usable: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n, cls, leading) of shingles that another set of a fitting size class has in its prefix too; leading: among the leading ones of both."""
    rows = tokens.join(usable.select("rep", "n", _size_class(F.col("n"), percent).alias("cls")), "rep")
    keyed = rows.withColumn("near", F.explode(F.array(F.col("cls"), F.col("cls") + 1)))
    often = keyed.groupBy("token", "near").agg(F.count("*").alias("c"), F.count_if("leading").alias("lead")).where("c > 1").select("token", "near", "lead")
    found = keyed.join(often, ["token", "near"]).withColumn("leading", F.col("leading") & (F.col("lead") > 1))
    return found.groupBy("token", "rep", "n", "cls").agg(F.bool_or("leading").alias("leading"))


def _asked(tokens: DataFrame, places: DataFrame, comps: DataFrame, percent: int, few: bool) -> DataFrame:
    """(rep, block): sets that share enough prefix shingles with sets of another block, of a fitting size class and in larger groups.

    few: only FIRST_SENT sets of each group ask, by a few shingles, and only the blocks that share most of those. Otherwise a
    set asks no block unless all larger groups together share enough.
    """
    ranks = comps.join(comps.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("rep", "comp", F.struct("size", "comp").alias("rank"))
    rows = written(tokens.join(places.select("rep", "block"), "rep").join(ranks, "rep"), "placed")
    asking = rows
    if few:
        turn = F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("rep")))
        asking = rows.join(comps.join(places.select("rep"), "rep").withColumn("turn", turn).where(F.col("turn") <= FIRST_SENT).select("rep"), "rep", "left_semi")
        place = F.row_number().over(Window.partitionBy("rep").orderBy("token"))
        asking = asking.withColumn("place", place).where(F.col("place") <= FIRST_SHINGLES).drop("place")
    least = 1 + F.floor(F.col("n") * percent / 100 / SLACK)
    asking = asking.withColumn("near", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    larger = F.col("most") > F.col("rank")
    summary = F.max("rank").alias("most")
    anywhere = rows.groupBy("token", "cls").agg(summary).withColumnRenamed("cls", "near")
    lively = asking.join(anywhere, ["token", "near"]).where(larger).drop("most")
    if few:
        least = F.lit(1)
    enough = lively.groupBy("rep", "n").agg(F.countDistinct("token").alias("w"), F.bool_or("leading").alias("led")).where((F.col("w") >= least) & F.col("led")).select("rep")
    asking = written(lively.join(enough, "rep", "left_semi"), "asking")
    there = rows.groupBy("token", "cls", "block").agg(summary, F.bool_or("leading").alias("led")).withColumnsRenamed({"block": "to", "cls": "near"})
    pairs = asking.join(there, ["token", "near"]).where((F.col("block") != F.col("to")) & larger)
    found = pairs.groupBy("rep", "n", "to").agg(F.count("*").alias("w"), F.bool_or(F.col("leading") & F.col("led")).alias("led")).where((F.col("w") >= least) & F.col("led"))
    if few:
        found = found.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("w"), "to"))).where(F.col("k") <= FIRST_BLOCKS)
    return found.select("rep", F.col("to").alias("block"))


def _sent(asked: DataFrame, places: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges found by sending the asked sets to their blocks."""
    chunks = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
    members = places.select("rep", "block").join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asking = asked.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = members.select("rep", "block", "chunk", F.lit(True).alias("member"), F.lit(False).alias("query"))
    rows = rows.unionByName(asking.select("rep", "block", "chunk", F.lit(False).alias("member"), F.lit(True).alias("query")))
    return _searched(rows, comps, sets, percent)


def _searched(rows: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    whole = rows.join(comps, "rep").join(sets, "rep")
    return whole.groupBy("block", "chunk").applyInPandas(lambda f: search_block(f, percent), "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    size: words of a shingle; percent: two sets link when 100 * intersection >= percent * union.
    """
    cut = written(_prefixes(docs, size, percent, _frequent(docs, size, percent)), "prefixes")
    reps = cut.where("n > 0").groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    reps = written(reps, "reps")
    usable = reps.where("doc_id is not null")
    tokens = _tokens(usable, percent)
    shared = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    tokens = written(tokens.join(shared, "token"), "tokens")
    least = 1 + F.floor(F.col("n") * percent / 100 / SLACK)
    tokens = written(_met(tokens, usable, percent), "met")
    active = tokens.groupBy("rep", "n", "cls").agg(F.count("*").alias("m"), F.min(F.when(F.col("leading"), F.col("token"))).alias("key")).where((F.col("m") >= least) & F.col("key").isNotNull())
    active = written(active, "active")
    families = active.groupBy("cls", "key").agg(F.count("*").alias("size"))
    fits = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(SHINGLES) / F.max("n"))))
    classes = active.groupBy("cls").agg(fits.alias("fits"), F.ceil(2 * F.count("*") / fits).alias("blocks"))
    placed = active.join(families, ["cls", "key"]).join(classes, "cls").withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / F.col("fits"))))
    block = F.col("cls").cast("long") * (1 << 32) + F.pmod(F.xxhash64("key", "salt"), F.col("blocks"))
    places = written(placed.select("rep", "n", block.alias("block")), "places")
    spots = written(usable.select("rep", "doc_id").join(places.select("rep"), "rep", "left_semi"), "spots")
    sets = written(_active_sets(docs, spots, size).join(places.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), "sets")
    tokens = written(tokens.join(places.select("rep"), "rep", "left_semi"), "tokens")
    comps = places.select("rep", F.col("rep").alias("comp"))
    own = places.select("rep", "block", F.lit(0).alias("chunk"), F.lit(True).alias("member"), F.lit(True).alias("query"))
    edges = written(_searched(own, comps, sets, percent), "links")

    def regrouped() -> DataFrame:
        found = components(edges)
        return written(places.select("rep").join(found, places["rep"] == found["node"], "left").select("rep", F.coalesce("label", "rep").alias("comp")), "groups")

    comps = regrouped()
    for few in (True, False):
        asked = written(_asked(tokens, places, comps, percent, few), "asked")
        if asked.limit(1).count():
            edges = edges.unionByName(written(_sent(asked, places, comps, sets, percent), "links"))
            comps = regrouped()
    named = reps.select("rep", "doc_id").join(comps, "rep", "left").select("rep", "doc_id", F.coalesce("comp", "rep").alias("comp"))
    named = named.join(named.groupBy("comp").agg(F.min("doc_id").alias("least")), "comp").select("rep", "least")
    out = cut.join(named, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with the smallest doc_id of their group, with all their columns; rows without an id stay."""
    gone = groups(docs.select("doc_id", "text"), size, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
