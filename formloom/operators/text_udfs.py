"""The few operators that need more than SQL: fuzzy aliases, scrubbing of known values, encryption, prompts."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.functions import text
from formloom.functions.dialect import SPARK
from formloom.functions.dictionary import FIELDS, tokens

FLOOR, SURE = 0.82, 0.75


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def alias_fuzzy(label_texts: DataFrame, exact: DataFrame) -> DataFrame:
    """text, alias, key, ratio and pos of near matches, for labels and aliases without an exact one.

    Distinct windows of a label are held against the aliases of as many tokens whose length alone could reach the
    floor (2 * shorter / both), so the costly ratio sees few pairs.
    """
    spark = label_texts.sparkSession
    rows = [(key, a, " ".join(t), len(t)) for key, _, aliases, _ in FIELDS for a in aliases if (t := tokens(a))]
    aliases = F.broadcast(spark.createDataFrame(rows, "key string, alias string, alias_text string, n int"))  # the dictionary
    sizes = F.broadcast(aliases.select("n").distinct())
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tokens") - F.col("n")))
    windows = label_texts.where(F.size("tokens") > 0).join(sizes).withColumn("pos", F.explode(at))
    windows = windows.select("text", "n", "pos", F.array_join(F.slice("tokens", F.col("pos") + 1, F.col("n")), " ").alias("window"))
    short, both = F.least(F.length("window"), F.length("alias_text")), F.length("window") + F.length("alias_text")
    pairs = windows.join(aliases, "n").where(2 * short / both >= FLOOR)
    scored = pairs.select("window", "alias_text").distinct().withColumn("ratio", _ratio("window", "alias_text")).where(F.col("ratio") >= FLOOR)
    near = pairs.join(scored, ["window", "alias_text"]).join(exact.select("text", "alias"), ["text", "alias"], "left_anti")
    best = F.max_by(F.struct("ratio", "pos"), F.struct("ratio", -F.col("pos")))
    return near.groupBy("text", "key", "alias").agg(best.alias("best")).select("text", "key", "alias", F.round("best.ratio", 6).alias("ratio"), F.col("best.pos").cast("long").alias("pos"))


def scrub_known(rows: DataFrame) -> DataFrame:
    """rows (text, known array<string>) with the known values taken out, longest first, whatever their case.

    Both are held in one Unicode form. A value of one character is taken out as a word after a colon only.
    """
    mark = "\x00"
    folded = rows.withColumn("text", nfc("text")).withColumn("known", F.split(nfc(F.array_join(F.transform("known", lambda v: F.trim(F.replace(v, F.lit(mark), F.lit("")))), mark)), mark))
    known = F.array_sort(F.array_distinct(F.filter("known", lambda v: v != "")), lambda a, b: F.when(F.length(b) != F.length(a), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    plain = lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    cut = lambda t, v: F.when(F.length(v) > 1, F.regexp_replace(t, F.concat(F.lit("(?iu)"), plain(v)), F.lit("[answer]"))).otherwise(F.regexp_replace(t, F.concat(F.lit(r"(:\s*)"), plain(v), F.lit(r"(?![\p{L}\p{N}_])")), F.lit("$1[answer]")))
    return folded.withColumn("known", known).withColumn("text", F.when(F.col("text").isNotNull(), F.aggregate("known", F.col("text"), cut)))


def scrub_stream(text: Column) -> Column:
    """A label without what follows its colon."""
    return F.regexp_replace(text, r"(?<=:)\s*\S.*$", "")


def sensitive_store(values: DataFrame, key: str) -> DataFrame:
    """(slug, key, value) encrypted and bound to their names; the last value of a name (by seq) counts, an empty one deletes."""
    last = values.groupBy("slug", "key").agg(F.max_by("value", "seq").alias("value")).where("value <> ''")
    name = F.concat_ws("/", "slug", "key")
    sealed = F.aes_encrypt(F.col("value"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), name)
    return last.select("slug", "key", sealed.alias("ciphertext"))


def opened(store: DataFrame, key: str) -> DataFrame:
    """A store's rows with their values; a row that was moved to another name fails."""
    value = F.aes_decrypt(F.col("ciphertext"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.concat_ws("/", "slug", "key"))
    return store.withColumn("value", value.cast("string"))


def lazy_unlock(wanted: DataFrame, ruled_out: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Values of the wanted keys that are not ruled out; nothing else is decrypted."""
    asked = wanted.join(ruled_out, ["form_id", "key"], "left_anti")
    held = store.join(asked.select("slug", "key").distinct(), ["slug", "key"], "left_semi")
    return asked.join(opened(held, key).select("slug", "key", "value"), ["slug", "key"])


def prompt_batch(blanks: DataFrame) -> DataFrame:
    """One JSON list of questions per form, with scrubbed labels and no values; blanks: form_id, blank_no, qid, label, kind."""
    label = F.left(F.regexp_replace("label", "[0-9]{3,}", "[answer]"), F.lit(220))
    item = F.struct("blank_no", "qid", label.alias("label"), "kind")
    asked = blanks.groupBy("form_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return asked.select("form_id", F.to_json(F.transform("items", lambda x: F.struct(x["qid"].alias("id"), x["label"].alias("label"), x["kind"].alias("kind")))).alias("prompt"))


#: Keys that no model is asked about: they are worked out.
NOT_ASKED = ("date_today", "llc_tax_code")
LABEL_CHARS = 220
ASK = (
    "Check how the blanks of a form were matched with stored details, for the {kind} who fills it. For every blank give the key of the detail that belongs there, or null to leave it empty: "
    "the same key as matcher_put to agree, another one to correct it. Leave empty what is somebody else's, what you would need to know more for, and every checkbox. If in doubt, leave it empty. "
    'Reply with JSON only: {{"blanks": [{{"id": "q1", "key": null, "why": "short"}}], "questions": []}}. Keys: {keys} Blanks: '
)


def prompts(blanks: DataFrame) -> DataFrame:
    """form_id and the question that a model is asked about a form: keys by name, and blanks as they are printed, without any value.

    blanks: form_id, blank_no, qid, kind, page, width_pt, label slots, fmt, identity_kind, put (the key that the matcher
    filled in) and known (the form's and the identity's values, which are taken out of labels). Labels of a text stream
    also lose what follows their colons.
    """
    slots = {"beside": F.when(F.col("right_") != "", F.col("right_")).otherwise(F.col("left_")), "above": F.col("above"), "section": F.col("section"), "field_name": F.col("native_name")}
    base = blanks.select("form_id", "blank_no", "qid", "kind", "page", F.bround("width_pt").cast("long").alias("width_pt"), "fmt", "identity_kind", "put", "known", F.map_from_arrays(F.array(*map(F.lit, slots)), F.array(*slots.values())).alias("slots"))
    texts = base.select("form_id", "blank_no", "known", "fmt", F.explode("slots").alias("slot", "text")).where("text <> ''")
    shapes = F.expr(text.scrub_shapes(SPARK, "text"))
    clean = scrub_known(texts).withColumn("text", shapes).withColumn("text", F.when(F.col("fmt") == "docx", F.expr(text.scrub_stream(SPARK, "text"))).otherwise(F.col("text")))
    said = clean.groupBy("form_id", "blank_no").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.left("text", F.lit(LABEL_CHARS)).alias("text")))).alias("said"))
    whole = base.drop("slots", "known").join(said, ["form_id", "blank_no"], "left")
    item = F.struct("blank_no", F.struct(F.col("qid").alias("id"), "kind", "page", "width_pt", *[F.col("said")[c].alias(c) for c in slots], F.col("put").alias("matcher_put")).alias("blank"))
    asked = whole.groupBy("form_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("identity_kind").alias("who"))
    keys = json.dumps([{"key": k, "means": title} for k, title, _, _ in FIELDS if k not in NOT_ASKED])
    before, after = ASK.format(kind="\x00", keys=keys).split("\x00")
    return asked.select("form_id", F.concat(F.lit(before), "who", F.lit(after), F.to_json(F.transform("items", lambda x: x["blank"]))).alias("prompt"))
