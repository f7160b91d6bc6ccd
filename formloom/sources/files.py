"""Reading inputs of the form model, and writing what was decided."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("pdf", "docx")


def form_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder: path, length, fmt (null: refused). Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("fmt", F.when(suffix.isin(*FORMATS), suffix))


def ocr_words(spark: SparkSession, path: str, least: int = 40, dpi: int = 150) -> DataFrame:
    """Words of a recogniser's tab-separated rows, in points."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    number = lambda k: F.get("c", F.lit(k)).try_cast("double")
    rows = rows.where((F.size("c") >= 12) & (F.trim(F.get("c", F.lit(11))) != "") & (number(10) >= least))
    x0, y0, w, h = (number(k) * 72 / dpi for k in (6, 7, 8, 9))
    return rows.select(F.get("c", F.lit(11)).alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"))


def identity_json(files: DataFrame) -> DataFrame:
    """slug, kind, key and value of identity files (slug, json); a flat map counts as values, blank values drop."""
    whole = F.from_json("json", "struct<kind:string,values:map<string,string>>")
    flat = F.from_json("json", "map<string,string>")
    df = files.withColumn("whole", whole).withColumn("values", F.coalesce(F.col("whole.values"), flat))
    out = df.select("slug", F.coalesce(F.col("whole.kind"), F.lit("person")).alias("kind"), F.explode("values").alias("key", "value"))
    return out.where(F.trim("value") != "")


def memory_json(memory: DataFrame) -> DataFrame:
    """Memory files (fingerprint, json) as rows (fingerprint, part, slug, blank_id, key, page, kind, x, y) of five tables.

    keys: blank to key. checked and cleared: blanks by identity; a plain list of checked ones is the saver's. placed:
    objects with page, kind and place, others drop. moved: blanks with two numbers, others drop.
    """
    raw = F.from_json("json", "struct<keys:map<string,string>,checked:string,cleared:map<string,array<string>>,placed:array<string>,moved:map<string,string>,saved_by:string>")
    df = memory.select("fingerprint", raw.alias("m")).where("m is not null")
    none = {"slug": F.lit(""), "blank_id": F.lit(None).cast("string"), "key": F.lit(None).cast("string"), "page": F.lit(None).cast("long"), "kind": F.lit(None).cast("string"), "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")}
    part = lambda d, name, **cells: d.select("fingerprint", F.lit(name).alias("part"), *[(cells.get(c, e)).alias(c) for c, e in none.items()])
    keys = part(df.select("fingerprint", F.explode("m.keys").alias("b", "k")), "keys", blank_id=F.col("b"), key=F.col("k"))
    listed = F.when(F.col("m.checked").startswith("["), F.create_map(F.coalesce("m.saved_by", F.lit("")), F.from_json("m.checked", "array<string>")))
    marks = lambda name, by: part(df.select("fingerprint", F.explode(by).alias("s", "l")).select("fingerprint", "s", F.explode("l").alias("b")), name, slug=F.col("s"), blank_id=F.col("b"))
    checked = marks("checked", F.coalesce(listed, F.from_json("m.checked", "map<string,array<string>>")))
    at = F.from_json("p", "struct<page:long,kind:string,x:double,y:double>")
    placed = df.select("fingerprint", F.explode("m.placed").alias("p")).where(F.col("p").startswith("{")).select("fingerprint", at.alias("p"))
    placed = part(placed, "placed", page=F.col("p.page"), kind=F.col("p.kind"), x=F.col("p.x"), y=F.col("p.y"))
    moved = df.select("fingerprint", F.explode("m.moved").alias("b", "v")).select("fingerprint", "b", F.from_json("v", "array<double>").alias("v")).where("size(v) = 2 and v[0] is not null and v[1] is not null")
    return keys.unionByName(checked).unionByName(marks("cleared", F.col("m.cleared"))).unionByName(placed).unionByName(part(moved, "moved", blank_id=F.col("b"), x=F.col("v")[0], y=F.col("v")[1]))


def memory_files(remembered: DataFrame) -> DataFrame:
    """What is remembered of every structure as one JSON object: the files that memory_json() reads."""
    of = lambda part: F.col("part") == part
    marks = remembered.where("part in ('checked', 'cleared')").groupBy("fingerprint", "part", "slug").agg(F.array_sort(F.collect_list("blank_id")).alias("blanks"))
    marks = marks.groupBy("fingerprint").agg(*[F.map_from_entries(F.collect_list(F.when(of(p), F.struct("slug", "blanks")))).alias(p) for p in ("checked", "cleared")])
    rest = remembered.groupBy("fingerprint").agg(
        F.map_from_entries(F.collect_list(F.when(of("keys"), F.struct("blank_id", "key")))).alias("keys"), F.collect_list(F.when(of("placed"), F.struct("page", "kind", "x", "y"))).alias("placed"),
        F.map_from_entries(F.collect_list(F.when(of("moved"), F.struct("blank_id", F.array("x", "y").alias("by"))))).alias("moved"),
    )
    return rest.join(marks, "fingerprint", "left").select("fingerprint", F.to_json(F.struct("keys", "checked", "cleared", "placed", "moved")).alias("json"))


def write_filled(entries: DataFrame, source: str, out: str) -> None:
    """Decisions to a new folder, by format; never over the source, never over what is there."""
    if source.rstrip("/") == out.rstrip("/"):
        raise ValueError("the filled copy cannot take the place of its source")
    entries.write.mode("errorifexists").partitionBy("fmt").parquet(out)


def through_json(rows: DataFrame, of: str, key: str, value: str) -> DataFrame:
    """Rows (of, key, value) with a value, written as one JSON object for each `of` and read back; of equal keys the largest value counts."""
    named = rows.where(F.col(key).isNotNull() & (F.col(value) != "")).groupBy(of, key).agg(F.max(value).alias(value))
    objects = named.groupBy(of).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("js"))
    return objects.select(of, F.explode(F.from_json("js", "map<string,string>")).alias(key, value))
