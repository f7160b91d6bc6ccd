"""The watched folder as a stream: arrivals, settled files, and one notice a path for good.

The batch twins of these steps are the operators of formloom.operators.pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.streaming.ledger import Ledger


def arrivals_source(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Change events of forms only, with a watermark; stream: path, size, ts."""
    forms = stream.where(F.lower("path").rlike(r"\.(pdf|docx)$"))
    return forms.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def settled_files(arrivals: DataFrame, quiet: str = "6 hours") -> DataFrame:
    """The last size of each burst of changes that a quiet time has closed."""
    bursts = arrivals.groupBy("path", F.session_window("ts", quiet)).agg(F.max_by("size", "ts").alias("size"), F.max("ts").alias("ts"))
    return bursts.where("size > 0").select("path", "size", "ts")


def one_notice(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each path once, ever, to the notices under `path`; only the buckets of a batch's paths are read."""

    def add(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("path").agg(F.min("ts").alias("ts"))
        notices = Ledger(batch.sparkSession, path, ("path",))
        notices.add(first.join(notices.near(first, first.schema).select("path"), "path", "left_anti"), number)

    return add


def is_form(notices: DataFrame, blank_counts: DataFrame, least: int = 3) -> DataFrame:
    """Stream-static join: whether a path has enough blanks; unread ones have none."""
    joined = notices.join(blank_counts.select("path", "blanks"), "path", "left").withColumn("blanks", F.coalesce("blanks", F.lit(0)))
    return joined.withColumn("is_form", F.col("blanks") >= least)


def _schema(columns: str) -> T.StructType:
    out = T.StructType()
    for c in columns.split(", "):
        out = out.add(*c.split())
    return out


_SAVED = _schema("fingerprint string, blank_id string, key string, seq long")
_REMEMBERED = _schema("fingerprint string, part string, slug string, blank_id string, key string, page long, kind string, x double, y double, seq long")


def memory_upsert(path: str, width: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for saves (fingerprint, blank_id, key, seq): the last save of a fingerprint wins."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in _SAVED.fields])
        Ledger(batch.sparkSession, path, ("fingerprint",), "seq", width).add(rows, number)

    return put


def memory_now(spark: SparkSession, path: str) -> DataFrame:
    """The remembered keys: the rows of each fingerprint's last save."""
    return Ledger(spark, path, ("fingerprint",), "seq").now(_SAVED)


def memory_tables_upsert(path: str, width: int = 8) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for whole saves, as rows of remember_form().

    Keys, moves and placed blanks are replaced by any later save of the form, ticks and clears by a later save of the same
    identity. A save that leaves a part empty says so by a row of that part without a blank.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in _REMEMBERED.fields]).fillna("", ["slug"])
        Ledger(batch.sparkSession, path, ("fingerprint", "part", "slug"), "seq", width).add(rows, number)

    return put


def memory_tables_now(spark: SparkSession, path: str) -> DataFrame:
    """What is remembered of every form, part by part."""
    return Ledger(spark, path, ("fingerprint", "part", "slug"), "seq").now(_REMEMBERED).where("blank_id is not null")
