"""Tables written to the folder that the cluster shares, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode may it be unset (as in tests): a new temporary folder is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not (kept := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get()
    return found.rstrip("/")


def written(df: DataFrame, name: str, most: int = 0) -> DataFrame:
    """df, written as Parquet to a new place in the shared folder and read again; where given, with at most so many rows a file.

    Parquet is read by up to 4,096 rows at a time, but never of two files; that bounds what a reader holds of wide rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/formloom/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, tasks: int, key: str) -> DataFrame:
    """df, written to a new place in the shared folder in as many buckets of key as tasks, and read again.

    What meets by that key, or by it and others, is joined and grouped without being dealt again. The table's name is new,
    so it goes with the session's catalog and no other query finds it.
    """
    table = f"formloom_{name}_{uuid.uuid4().hex}"
    out = df.repartition(tasks, key).write.format("parquet").bucketBy(tasks, key)
    out.option("path", f"{shared_dir(df.sparkSession)}/formloom/{table}").saveAsTable(table)
    return df.sparkSession.table(table)
