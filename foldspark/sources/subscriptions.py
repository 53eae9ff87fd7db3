"""Subscribers that join a running file log: what was there when they registered is behind them, or theirs to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.sources.feeds import read_changes
from foldspark.sources.run_store import RunStore


class Subscriptions:
    """The start positions of a log's subscribers, in a table under `path`; one registers at a time.

    `sequence` is the log's integer column that ascends with arrival, in each `shard` if there is such a column.
    """

    def __init__(self, spark: SparkSession, path: str, log: str, sequence: str, shard: str | None = None):
        self.spark, self.log, self.sequence, self.shard = spark, log, sequence, shard
        self.table = RunStore(spark, path, ["name", "shard"], lambda rows: rows.groupBy("name", "shard").agg(F.min("since").alias("since")))

    def _shard(self):
        return F.col(self.shard).cast("string") if self.shard else F.lit("")

    def register(self, name: str, from_log: bool = False) -> None:
        """Remember where the log ends now, or with `from_log` that the subscriber reads all of it.

        Registering again changes nothing: the first start position stays.
        """
        known = self.table.read()
        if known is not None and not known.where(F.col("name") == name).isEmpty():
            return
        version = (self.table.versions()[-1:] or [-1])[0] + 1
        nobody = self.spark.createDataFrame([(name, None, None)], "name string, shard string, since long")  # says that the name is there
        ends = self.spark.read.parquet(self.log).groupBy(self._shard().alias("shard")).agg(F.max(self.sequence).cast("long").alias("since"))
        self.table.append(nobody if from_log else nobody.unionByName(ends.select(F.lit(name).alias("name"), "shard", "since")), version)

    def read(self, name: str, per_batch: int = 1) -> DataFrame:
        """The subscriber's stream: the log's records after its start position; a shard that began later is read whole.

        The position is fixed when a subscriber registers and not when its query starts, so nothing that arrives in between is
        lost. The start positions, a row a shard, are joined to each micro-batch.
        """
        known = self.table.read()
        mine = None if known is None else known.where((F.col("name") == name)).select(F.col("shard").alias("_of"), F.col("since").alias("_since"))
        if mine is None or mine.isEmpty():
            raise LookupError(f"{name} is not registered")
        stream = read_changes(self.spark, self.log, per_batch=per_batch)
        joined = stream.join(mine, self._shard().eqNullSafe(F.col("_of")) & F.col("_since").isNotNull(), "left")
        return joined.where(F.col("_since").isNull() | (F.col(self.sequence) > F.col("_since"))).drop("_of", "_since")
