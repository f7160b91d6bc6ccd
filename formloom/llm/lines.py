"""Removal of repeated runs of lines by a suffix array over line ids, built with distributed prefix doubling.

Every text is its sequence of lines with a word; other lines take no part and stay. Lines that occur once in the corpus
end every run, so only suffixes that begin with a repeated line are sorted.

1. Prefix doubling: suffixes are sorted by their first line, then by 2, 4, 8 ... lines, each time by (own rank, rank of
   the suffix as many lines later). A sort is dealt over ranges of all tasks; each range numbers its rows and one
   summary a range meets in the driver. Suffixes whose prefix is unique have their final place and drop out of later
   sorts; it ends when all have dropped out, which is after the longest repeat.
2. Longest common prefixes: two neighbours of the suffix array part in one of those sorts. Their longest common prefix
   is then put together from the ranks of the shorter sorts, from the longest to the shortest.
3. Suffixes that agree on min_lines lines are one interval of the suffix array. Its first suffix in document order is
   the original; all others start later copies, and the lines of all later copies are deleted. Later copies that follow
   each other line by line thereby go as one maximal repeated run.

With passage_words, a single line of so many words or more is a passage of its own: its later copies are deleted too,
whatever lines stand around them.

"First" is by (doc_id, hash of the text, line number). Nulls: a null text has no lines; a null doc_id comes first.
Rows equal in doc_id and text are one document here: each keeps the same lines. A copy may overlap its original. Empty
tables give empty results. Extra columns are kept, whatever their names; only those that are named like the columns
that without_repeated_runs() adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.bitmaps import bitmap, passes
from formloom.llm.shared import written

MIN_LINES = 2
#: Words that make a single line a passage: as many as a repeated window of op7_substrings has.
PASSAGE_WORDS = 35

_AT = ["doc", "th", "i"]
_GAP = " \t\x0b\x0c\r"


def _has_word(line):
    return F.ltrim(line, F.lit(_GAP)) != ""


def _has_words(line, n: int):
    return F.rlike(line, F.lit(rf"^[ \t\x0b\x0c\r]*+(?:[^ \t\x0b\x0c\r]++[ \t\x0b\x0c\r]++){{{n - 1}}}[^ \t\x0b\x0c\r]"))


def sorted_suffixes(rows: DataFrame, by: list[str], name: str) -> tuple[DataFrame, bool]:
    """One sort of the doubling: rows (doc, th, i, own, the long columns `by`, alone) with their new places.

    own: the rank so far, equal for suffixes that agree so far. alone: nothing equals this row. Adds rank (new rank),
    later (a row with the same new rank comes before it in document order), multi (another row has the same new rank)
    and, where a row parts from the suffix before it only now, that suffix as (pdoc, pth, pi), else nulls. Also returns
    whether any two rows have the same new rank.
    """
    key = ["own", *by]
    given = rows.select(*_AT, *key, "alone")
    dealt = given.repartitionByRange(*key, *_AT).sortWithinPartitions(*key, *_AT).withColumn("part", F.spark_partition_id())
    numbers = [("n", "long"), ("s", "long"), ("t", "long"), ("same", "boolean"), ("goes_on", "boolean"), ("parts", "boolean")]
    numbers += [("pdoc", "long"), ("pth", "long"), ("pi", "long")]
    schema = T.StructType([T.StructField(c, T._parse_datatype_string(k), True) for c, k in [("part", "int"), *[(c, "long") for c in _AT + key], *numbers]])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n: the row's number in its range; s and t: those at which its own rank and its key begin there."""
        held, before, n, s, t = None, None, 0, 0, 0

        def out(f: dict[str, np.ndarray], after: dict[str, np.ndarray] | None) -> pa.RecordBatch:
            nonlocal before, n, s, t
            m, lo = len(f["own"]), int(before is not None)
            whole = {c: np.concatenate([x[c] for x in (before, f, after) if x is not None]) for c in [*key, "alone"]}
            own = whole["own"][1:] == whole["own"][:-1]
            same = own & ~whole["alone"][1:] & ~whole["alone"][:-1]
            for c in by:
                same &= whole[c][1:] == whole[c][:-1]
            own_here, same_here = np.zeros(m, bool), np.zeros(m, bool)
            own_here[1 - lo :], same_here[1 - lo :] = own[: m - 1 + lo], same[: m - 1 + lo]
            at = n + np.arange(m)
            starts = np.maximum.accumulate(np.where(own_here, s, at))
            begins = np.maximum.accumulate(np.where(same_here, t, at))
            goes_on = np.append(same_here[1:], after is not None and same[-1])
            unknown = np.zeros(m, bool)
            unknown[-1] = after is None
            parts = own_here & ~same_here
            columns = [f[c] for c in ["part", *_AT, *key]] + [at, starts, begins, same_here]
            columns = [*map(pa.array, columns), pa.array(goes_on, mask=unknown), pa.array(parts)]
            columns += [pa.array(np.concatenate([f[c][:1] if before is None else before[c], f[c][:-1]]), mask=~parts) for c in _AT]
            before, n, s, t = {c: x[-1:] for c, x in f.items()}, n + m, int(starts[-1]), int(begins[-1])
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for b in batches:
            if not len(b):
                continue
            f = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
            if held is not None:
                yield out(held, {c: x[:1] for c, x in f.items()})
            held = f
        if held is not None:
            yield out(held, None)

    done = written(dealt.select("part", *_AT, *key, "alone").mapInArrow(numbered, schema), name)
    # one row a range: how its first and its last keys go on from range to range
    ends = done.groupBy("part").agg(
        F.count("*").alias("size"), F.max("same").alias("any"), F.min_by(F.struct(*_AT, *key), "n").alias("first"), F.max_by(F.struct(*_AT, *key, "s", "t"), "n").alias("last"),
    ).orderBy("part").collect()
    facts, offset, prior = [], 0, None
    for r in ends:
        own = prior is not None and prior[0].own == r.first.own
        same = own and all(prior[0][c] == r.first[c] for c in by) and not (by == ["next"] and r.first["next"] < 0)
        start, begin = (prior[1] if own else offset), (prior[2] if same else offset)
        facts.append([r.part, offset, start, begin, same, own and not same, *([prior[0][c] for c in _AT] if own and not same else [None] * 3), False])
        if same:
            facts[-2][-1] = True
        prior = (r.last, offset + r.last.s if r.last.s else start, offset + r.last.t if r.last.t else begin)
        offset += r.size
    known = rows.sparkSession.createDataFrame(facts, "part int, offset long, start long, begin long, same0 boolean, parts0 boolean, qdoc long, qth long, qi long, on0 boolean")
    joined = done.join(F.broadcast(known), "part")
    first = F.col("n") == 0
    place = lambda c, zero: F.when(F.col(c) == 0, F.col(zero)).otherwise(F.col("offset") + F.col(c))
    later = F.when(first, F.col("same0")).otherwise(F.col("same"))
    out = joined.select(
        *_AT, (F.col("own") + place("t", "begin") - place("s", "start")).alias("rank"), later.alias("later"), (later | F.coalesce("goes_on", "on0")).alias("multi"),
        *[F.when(first & F.col("parts0"), F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("pdoc", "qdoc"), ("pth", "qth"), ("pi", "qi"))],
    )
    return out, any(r.any for r in ends) or any(f[4] for f in facts)


def _ahead(ranks: DataFrame, step: int, name: str) -> DataFrame:
    """The ranks of the suffixes `step` lines later, by place."""
    return ranks.select("doc", "th", (F.col("i") - step).alias("i"), F.col("rank").alias(name))


def common_prefixes(parted: list[tuple[int, DataFrame]], classes: dict[int, DataFrame]) -> DataFrame:
    """doc, th, i, pdoc, pth, pi, lcp of neighbours in the suffix array.

    parted: for each length of the doubling the neighbours that agree on so many lines but not on twice as many;
    classes: by length, the ranks of the suffixes whose prefix of that length occurs twice or more.
    """
    state = None
    for length, new in sorted(parted, key=lambda x: -x[0]):
        if state is not None:
            ours = _ahead(classes[length], 0, "rank")
            here = state.withColumns({"ai": F.col("i") + F.col("lcp"), "bi": F.col("pi") + F.col("lcp")})
            a = ours.select(F.col("doc"), F.col("th"), F.col("i").alias("ai"), F.col("rank").alias("ra"))
            b = ours.select(F.col("doc").alias("pdoc"), F.col("th").alias("pth"), F.col("i").alias("bi"), F.col("rank").alias("rb"))
            here = here.join(a, ["doc", "th", "ai"], "left").join(b, ["pdoc", "pth", "bi"], "left")
            more = F.when(F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)), length).otherwise(0)
            state = here.select(*_AT, "pdoc", "pth", "pi", (F.col("lcp") + more).alias("lcp"))
        new = new.select(*_AT, "pdoc", "pth", "pi", F.lit(length).cast("long").alias("lcp"))
        state = written(new if state is None else state.unionByName(new), "prefixes")
    return state


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, passage_words: int | None = None, lengths: bool = True) -> DataFrame:
    """doc, th, starts, singles and longest, of the documents with a repeat.

    starts: lines (counted among those with a word) at which a later copy of min_lines lines begins; singles: later
    copies of one line of passage_words words or more (none without that number). longest: lines of the document's
    longest run that occurs elsewhere too, 0 below min_lines (0 without `lengths`, which sorts no further than needed).
    docs: doc, th, text.
    """
    lines = docs.select("doc", "th", F.posexplode(F.filter(F.split("text", "\n"), _has_word)).alias("i", "line"))
    long = _has_words(F.col("line"), passage_words) if passage_words else F.lit(False)
    lines = lines.select("doc", "th", F.col("i").cast("long").alias("i"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), long.alias("long"))
    often = written(lines.groupBy("h", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h", "h2"), "often")
    lines = written(lines.join(often.hint("merge"), ["h", "h2"]).dropDuplicates(_AT), "lines")
    order, more = sorted_suffixes(lines.withColumns({"own": F.lit(0).cast("long"), "alone": F.lit(False)}), ["h", "h2"], "order-1")
    singles = order.where("later").join(lines.where("long").select(*_AT), _AT, "left_semi") if passage_words else order.limit(0)
    length, classes, settled, parted, starts = 1, {}, [], [], None
    if min_lines == 1:
        starts = order.where("later")
    while True:
        settled.append(order.where("not multi").select(*_AT, "rank"))
        classes[length] = order.where("multi").select(*_AT, "rank")
        if starts is None and length < min_lines < 2 * length:  # the order by exactly min_lines, from two overlapping ranks
            pairs = classes[length].withColumnRenamed("rank", "own").join(_ahead(classes[length], min_lines - length, "next"), _AT).withColumn("alone", F.lit(False))
            starts = sorted_suffixes(written(pairs, "pairs"), ["next"], "order-exact")[0].where("later")
        if starts is not None and not lengths or not more:
            break
        ranks = classes[length]
        for x in settled:
            ranks = ranks.unionByName(x)
        pairs = classes[length].withColumnRenamed("rank", "own").join(_ahead(ranks, length, "next"), _AT, "left")
        pairs = pairs.withColumns({"alone": F.col("next").isNull(), "next": F.coalesce("next", F.lit(-1).cast("long"))})
        order, more = sorted_suffixes(written(pairs, "pairs"), ["next"], f"order-{2 * length}")
        parted.append((length, order.where("pi is not null")))
        length *= 2
        if length == min_lines:
            starts = order.where("later")
    found = singles.select(*_AT, F.lit("singles").alias("kind"))
    if starts is not None:
        found = found.unionByName(starts.select(*_AT, F.lit("starts").alias("kind")))
    rows = found.select(*_AT, "kind", F.lit(0).cast("long").alias("longest"))
    if lengths and parted:
        both = common_prefixes(parted, classes).where(F.col("lcp") >= min_lines)
        for d, t in (("doc", "th"), ("pdoc", "pth")):
            most = both.groupBy(F.col(d).alias("doc"), F.col(t).alias("th")).agg(F.max("lcp").alias("longest"))
            rows = rows.unionByName(most.select("doc", "th", F.lit(None).cast("long").alias("i"), F.lit("run").alias("kind"), "longest"))
    lists = [F.collect_list(F.when(F.col("kind") == n, F.col("i"))).alias(n) for n in ("starts", "singles")]
    return written(rows.groupBy("doc", "th").agg(*lists, F.max("longest").alias("longest")), "copies")


def without_repeated_runs(
    docs: DataFrame, min_lines: int = MIN_LINES, passage_words: int | None = None, lengths: bool = True, names: tuple[str, str, str] = ("n_lines", "n_removed", "longest_run")
) -> DataFrame:
    """docs with the lines of later copies taken out of text, and the columns `names`: lines with a word, how many of them
    were taken out, and the lines of the document's longest run that occurs twice."""
    rest = [c for c in docs.columns if c not in names]
    keyed = docs.select(*rest).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keyed.schema] + [T.StructField(n, T.LongType(), True) for n in names])
    keyed = keyed.withColumns({"_fl_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_fl_th": F.xxhash64("text")})
    keyed = keyed.withColumn("_fl_key", F.xxhash64("_fl_doc", "_fl_th"))
    copies = later_copies(keyed.select(F.col("_fl_doc").alias("doc"), F.col("_fl_th").alias("th"), "text"), min_lines, passage_words, lengths)
    copies = copies.withColumnsRenamed({"doc": "_fl_doc", "th": "_fl_th", "starts": "_fl_starts", "singles": "_fl_singles", "longest": "_fl_longest"})
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(copies.select(F.xxhash64("_fl_doc", "_fl_th")), copies.count()))
    at, n = rest.index("text"), len(rest)

    def picked(hit: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if (b := b.filter(pa.array(passes(bits.value, b.column(n + 2).to_numpy()) == hit))).num_rows:
                    yield b

        return keyed.mapInArrow(pick, keyed.schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.slice(lo, 1000)
                texts, total, removed = [], [], []
                for text, starts, singles in zip(*[b.column(k).to_pylist() for k in (at, n, n + 1)]):
                    lines = text.split("\n")
                    named = [k for k, x in enumerate(lines) if x.strip(_GAP)]
                    gone = {named[s + k] for s in starts or () for k in range(min_lines)} | {named[s] for s in singles or ()}
                    texts.append("\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else text)
                    total.append(len(named))
                    removed.append(len(gone))
                columns = [*b.columns[:n], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), b.column(n + 2)]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    # texts without a repeat stay where they are; the others meet their copies in one join, by the same plan at every size
    ours = picked(True).join(copies.hint("merge"), ["_fl_doc", "_fl_th"], "left").select(*rest, "_fl_starts", "_fl_singles", F.coalesce("_fl_longest", F.lit(0).cast("long")).alias("_fl_longest"))
    n_lines = F.size(F.filter(F.split("text", "\n"), _has_word)).cast("long")
    zero = F.lit(0).cast("long")
    others = picked(False).select(*rest, n_lines.alias(names[0]), zero.alias(names[1]), zero.alias(names[2]))
    return others.unionByName(ours.mapInArrow(cut, schema))
