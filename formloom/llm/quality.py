"""Quality rules by distribution divergence, in DataFrame functions only.

For each language (the lang column) with enough text, a reference is taken over all its documents: the histogram of
character classes and the histogram of its common words, which are the words that make up at least COMMON of all its
words. A document is held against the reference of its language by the Jensen-Shannon distance (base 2, so 0 to 1) of
either histogram, each only if the document is long enough for its histogram to mean something. Words of histograms and
windows are told apart by 64-bit hashes; windows with equal hashes are compared word by word.

Nulls: a null text has no words; a null or rare language has no reference, and its documents are held against the
reference of all documents together. Rows are judged one by one: repeated rows get the same verdict. Empty tables give
empty results. Extra columns are ignored by rules() and kept by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.shared import written

#: Least share of a language's words that makes a word common: at most 1 / COMMON words are.
COMMON = 0.005
#: Least share of all words that gives a language a reference: at most 1 / RARE languages have one.
RARE = 0.001
#: Largest distances of kept documents, and the words from which on each counts.
CHAR_DISTANCE, CHAR_WORDS = 0.25, 20
WORD_DISTANCE, WORD_WORDS = 0.43, 60

_GAP = r"[\x20\x09-\x0D]"
CLASSES = ("lower", "upper", "digit", "other_letter", "space", "symbol")


def words(text: Column) -> Column:
    """The words of a text, in order."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))


def _share(counts: Column) -> Column:
    """Counts as shares of their sum."""
    whole = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / whole)


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of five words that the text holds twice or more; df: w and h (hashes of w).

    Texts whose windows have distinct hashes are done. For the others, window hashes (36 bits) and positions (28 bits) are
    sorted in one array of longs; only windows that meet an equal hash there are compared word by word.
    """
    mask = (1 << 28) - 1
    get = F.get
    run = lambda of, start, less: F.slice(of, start, F.greatest(F.size("w") - less, F.lit(0)))
    both = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn("_2", F.zip_with(run("h", 1, 1), run("h", 2, 1), both))
    df = df.withColumn("_4", F.zip_with(run("_2", 1, 3), run("_2", 3, 3), both))
    df = df.withColumn("_5", F.zip_with(run("_4", 1, 4), run("h", 5, 4), both))
    code = lambda x, i: x.bitwiseAND(~mask).bitwiseOR(i.cast("long"))
    meets = F.size(F.array_distinct("_5")) < F.size("_5")
    df = df.withColumn("_s", F.when(meets, F.sort_array(F.transform("_5", code))).otherwise(F.array().cast("array<long>")))
    same = lambda a, b: F.coalesce(a.bitwiseXOR(b) <= mask, F.lit(False)) & F.coalesce(a.bitwiseXOR(b) >= 0, F.lit(False))
    before = lambda x, j: F.when(j > 0, get(F.col("_s"), j - 1))
    df = df.withColumn("_c", F.filter("_s", lambda x, j: same(x, before(x, j)) | same(x, get(F.col("_s"), j + 1))))
    item = lambda x: F.struct(F.slice(F.col("w"), x.bitwiseAND(mask).cast("int") + 1, 5).alias("k"), x.bitwiseAND(mask).cast("int").alias("p"))
    df = df.withColumn("_c", F.when(F.size("_c") > 0, F.sort_array(F.transform("_c", item))))
    prior = lambda j: F.when(j > 0, get(F.col("_c"), j - 1)["k"])
    twice = lambda x, j: F.coalesce(x["k"] == prior(j), F.lit(False)) | F.coalesce(x["k"] == get(F.col("_c"), j + 1)["k"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_c", twice), lambda x: x["p"])))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(5), F.coalesce(get(F.col("_p"), j + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_2", "_4", "_5", "_s", "_c", "_p")


def common_words(docs: DataFrame) -> DataFrame:
    """lang, common array<long> (hashes), common_share array<double> (the last: of all other words), n; and lang null for all."""
    exploded = docs.select("lang", F.explode(F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).alias("word"))
    counts = written(exploded.groupBy("lang", "word").agg(F.count("*").alias("c")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    everything = counts.agg(F.sum("c").alias("n"))
    large = totals.crossJoin(F.broadcast(everything.select(F.col("n").alias("all_n")))).where(F.col("lang").isNotNull() & (F.col("n") >= RARE * F.col("all_n")))
    by_lang = counts.join(F.broadcast(large.select("lang", "n")), "lang").where(F.col("c") >= COMMON * F.col("n"))
    overall = counts.groupBy("word").agg(F.sum("c").alias("c")).crossJoin(F.broadcast(everything)).where(F.col("c") >= COMMON * F.col("n"))
    top = by_lang.select("lang", "word", "c", "n").unionByName(overall.select(F.lit(None).cast("string").alias("lang"), "word", "c", "n"))
    top = top.groupBy("lang", "n").agg(F.sort_array(F.collect_list(F.struct("word", "c"))).alias("t"))
    shares = F.concat(F.transform("t", lambda x: x["c"] / F.col("n")), F.array((F.col("n") - F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["c"])) / F.col("n")))
    return top.select("lang", F.transform("t", lambda x: x["word"]).alias("common"), shares.alias("common_share"))


def _classified(df: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` of df, with `classes` (characters of each of CLASSES of text) and n_symbols.

    Each class is taken out of what the classes before it left, so that all but the first pattern read little text.
    """
    left, patterns = F.col("text"), ("[a-z]+", "[A-Z]+", "[0-9]+", r"[^\x00-\x7F]+", _GAP + "+")
    df = df.select(*carry, F.char_length(left).cast("long").alias("_n0"), left.alias("_left"))
    for k, pattern in enumerate(patterns):
        df = df.select(*carry, *[f"_n{j}" for j in range(k + 1)], F.regexp_replace("_left", pattern, "").alias("_left"))
        df = df.withColumn(f"_n{k + 1}", F.char_length("_left").cast("long"))
    classes = F.array(*[F.col(f"_n{k}") - F.col(f"_n{k + 1}") for k in range(len(patterns))], F.col(f"_n{len(patterns)}"))
    return df.select(*carry, classes.alias("classes"), F.char_length(F.regexp_replace("_left", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"))


def references(common: DataFrame, classes: DataFrame) -> DataFrame:
    """common with `ref`, the characters of each class in the language; classes: lang and classes of all documents."""
    parts = classes.select("lang", *[F.get("classes", F.lit(k)).alias(c) for k, c in enumerate(CLASSES)])
    sums = written(parts.groupBy("lang").agg(*[F.sum(c).cast("double").alias(c) for c in CLASSES]), "class-counts")
    ref = F.array(*[F.col(c) for c in CLASSES]).alias("ref")
    every = sums.select("lang", ref).where("lang is not null").unionByName(sums.agg(*[F.sum(c).alias(c) for c in CLASSES]).select(F.lit(None).cast("string").alias("lang"), ref))
    return written(common.join(every, common["lang"].eqNullSafe(every["lang"])).select(common["lang"], "common", "common_share", "ref"), "references")


def measures(docs: DataFrame, common: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` and lang, the counts of the base rules, classes, and counts: how often each common word of the language occurs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = _classified(docs.select(*carry, "lang", text.alias("text"), text.alias("whole")), [*carry, "lang", "whole"])
    named = F.broadcast(common.where("lang is not null").select("lang", "common"))
    other = F.broadcast(common.where("lang is null").select(F.col("common").alias("c0")))
    df = df.join(named, "lang", "left").join(other, how="left").withColumn("common", F.coalesce("common", "c0", F.array().cast("array<long>")))
    df = df.withColumn("w", words(F.col("whole")))
    df = _repeats(df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))))
    # the common words of any language first, by one look-up in a set of at most 1 / COMMON numbers a language
    some = sorted({x for r in common.select("common").collect() for x in r.common})
    df = df.withColumn("hit", F.filter("h", lambda x: x.isin(some)) if some else F.array().cast("array<long>"))
    start = F.struct(F.col("hit").alias("rest"), F.array().cast("array<int>").alias("sizes"))
    taken = F.aggregate("common", start, lambda s, x: F.struct(F.array_remove(s["rest"], x).alias("rest"), F.array_append(s["sizes"], F.size(s["rest"])).alias("sizes")))
    df = df.withColumn("taken", taken)
    sizes = F.array_append(F.col("taken.sizes"), F.size("taken.rest"))
    lines = F.filter(F.split("whole", "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    df = df.withColumns({"sizes": sizes, "lines": lines})
    return df.select(
        *carry, "lang", F.size("w").cast("long").alias("n_words"), "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "classes", F.transform("common", lambda x, k: F.get("sizes", k) - F.get("sizes", k + 1)).alias("counts"),
    )


def judged(found: DataFrame, known: DataFrame) -> DataFrame:
    """measures() with both distances, base_failed and kept; known: references()."""
    named = F.broadcast(known.where("lang is not null").select("lang", "common_share", "ref"))
    other = F.broadcast(known.where("lang is null").select(F.col("common_share").alias("s0"), F.col("ref").alias("r0")))
    df = found.join(named, "lang", "left").join(other, how="left")
    df = df.withColumns({"common_share": F.coalesce("common_share", "s0"), "ref": F.coalesce("ref", "r0")})
    hits = F.aggregate("counts", F.lit(0), lambda s, x: s + x)
    shares = F.transform(F.concat("counts", F.array((F.col("n_words") - hits).cast("int"))), lambda x: x / F.col("n_words"))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x) - F.get("classes", F.lit(CLASSES.index("space")))
    df = df.withColumns({
        "word_chars": chars,
        "char_distance": F.when(F.col("n_words") > 0, _distance(_share(F.col("classes").cast("array<double>")), _share(F.col("ref")))),
        "word_distance": F.when(F.col("n_words") > 0, _distance(shares, F.col("common_share"))),
    })
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = ((F.col("n_words") >= CHAR_WORDS) & (F.col("char_distance") > CHAR_DISTANCE)) | ((F.col("n_words") >= WORD_WORDS) & (F.col("word_distance") > WORD_DISTANCE))
    return df.withColumns({"base_failed": base, "kept": ~base & ~F.coalesce(far, F.lit(False))})


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    The measures of the rows are written once; the references of the character classes and the verdicts come from them.
    """
    docs = docs.select("doc_id", "lang", "text")
    common = written(common_words(docs), "common-words")
    found = written(measures(docs, common, ["doc_id"]), "measures")
    df = judged(found, references(common, found))
    rounded = [F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")]
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *rounded)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Here the classes are counted in a pass of their own, so that whole rows are judged as they are read and not written twice.
    """
    common = written(common_words(docs.select("lang", "text")), "common-words")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    known = references(common, _classified(docs.select("lang", text), ["lang"]))
    found = judged(measures(docs.select(F.struct(*docs.columns).alias("_row"), "lang", "text"), common, ["_row"]), known)
    # a column that is not deterministic keeps the filter above the projection: pushed below it, the verdict would be
    # spelt out from the text again for each use of each measure
    return found.select("_row", "kept", F.monotonically_increasing_id().alias("_at")).where("kept AND _at >= 0").select("_row.*")
