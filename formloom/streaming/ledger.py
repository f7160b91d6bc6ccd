"""A table that a stream adds to, batch by batch, at a cost that does not grow with the number of batches before.

Each batch is written as a run of its own, dealt over buckets of the key. When as many runs of one size have come together
as a run is wide, they are merged into one: so after n batches about log(n) runs are there, each row has been rewritten
about log(n) times, and a look at some keys reads the buckets that hold them and no others.

A run names the batches that it holds, so a batch that comes again is known and left out. A merged run appears by a rename;
runs that it holds are passed over from then on, whether or not they could be deleted.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = re.compile(r"batch=(\d+)-(\d+)$")


@dataclass(frozen=True)
class Ledger:
    """Rows under `path`; of those with equal `keys` the ones with the greatest `order` count, all of them if it is None."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: str | None = None
    width: int = 8
    buckets: int = 32

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def runs(self) -> list[tuple[int, int]]:
        """First and last batch of every run that counts, in order."""
        fs, at = self._files(self.path)
        if not fs.exists(at):
            return []
        found = []
        for x in fs.listStatus(at):
            name = x.getPath().getName()
            if (m := _RUN.match(name)) and fs.exists(self._files(f"{self.path}/{name}/_SUCCESS")[1]):
                found.append((int(m[1]), int(m[2])))
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _place(self, run: tuple[int, int]) -> str:
        return f"{self.path}/batch={run[0]:010d}-{run[1]:010d}"

    def _read(self, runs: list[tuple[int, int]], schema) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(None).cast("int"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return self.spark.read.schema(f"{columns}, bucket int").option("basePath", self.path).parquet(*map(self._place, runs)).select(*schema.names, "bucket")

    def _last(self, rows: DataFrame) -> DataFrame:
        if self.order is None:
            return rows.distinct()
        last = rows.groupBy(*self.keys).agg(F.max(self.order).alias(self.order))
        return rows.join(last, [*self.keys, self.order], "left_semi").select(*rows.columns).distinct()

    def _bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, place: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)

    def add(self, batch: DataFrame, number: int) -> None:
        """The rows of a batch, if it is not there already."""
        if any(lo <= number <= hi for lo, hi in self.runs()):
            return
        self._write(batch, self._place((number, number)))
        self._merge(batch.schema)

    def _merge(self, schema) -> None:
        size = lambda r: len(_digits(r[1] - r[0] + 1, self.width))
        while len(runs := self.runs()) >= self.width:
            tail = runs[-self.width :]
            if len({size(r) for r in tail}) > 1:
                return
            whole, scratch = (tail[0][0], tail[-1][1]), f"{self.path}/_merging-{uuid.uuid4().hex}"
            self._write(self._last(self._read(tail, schema).drop("bucket")), scratch)
            (fs, to), (_, made) = self._files(self._place(whole)), self._files(scratch)
            fs.rename(made, to)
            for r in tail:
                fs.delete(self._files(self._place(r))[1], True)

    def now(self, schema) -> DataFrame:
        """All rows that count."""
        return self._last(self._read(self.runs(), schema).drop("bucket"))

    def near(self, batch: DataFrame, schema) -> DataFrame:
        """The rows that count in the buckets of a batch's keys."""
        touched = [r.b for r in batch.select(self._bucket().alias("b")).distinct().collect()]  # `buckets` numbers at most
        return self._last(self._read(self.runs(), schema).where(F.col("bucket").isin(touched)).drop("bucket"))


def _digits(n: int, base: int) -> list[int]:
    out = []
    while n:
        n, d = divmod(n, base)
        out.append(d)
    return out
