"""What became of each micro-batch or window, kept in a table that restarts don't forget."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from foldspark.sources.run_store import RunStore

#: entry counts up over all restarts; before and after are the checkpoints around the attempt, equal where it failed.
SCHEMA = "entry long, run string, batch_id long, unit string, before string, after string, read long, applied long, late long, failed boolean, reason string"
Outcome = tuple[str, int, str, "str | None", "str | None", "int | None", "int | None", "int | None", bool, "str | None"]


class Outcomes:
    """An append-only table of outcomes, one writer at a time; runs of it are merged as they become many."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = RunStore(spark, path, ["entry"], DataFrame.distinct)

    def record(self, rows: Iterable[Outcome]) -> None:
        """Add rows (run, batch_id, unit, before, after, read, applied, late, failed, reason)."""
        entry = (self.table.versions()[-1:] or [-1])[0] + 1
        self.table.append(self.spark.createDataFrame([(entry, *r) for r in rows], SCHEMA), entry)

    def read(self) -> DataFrame:
        """All outcomes, in the order of `entry`."""
        found = self.table.read()
        return self.spark.createDataFrame([], SCHEMA) if found is None else found.orderBy("entry", "unit")


def recorded(step: Callable[[DataFrame, int], Any], path: str, run: str) -> Callable[[DataFrame, int], None]:
    """A step for foreachBatch whose outcome is recorded, also if it fails; then it fails as it would have.

    A step may return the number of rows that it applied; otherwise those that it read count. A batch that comes again after
    a failure has a row for each attempt.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        outcomes, at = Outcomes(batch.sparkSession, path), str(batch_id - 1)
        n = batch.count()
        try:
            applied = step(batch, batch_id)
        except Exception as e:
            outcomes.record([(run, batch_id, "batch", at, at, n, 0, None, True, str(e))])
            raise
        outcomes.record([(run, batch_id, "batch", at, str(batch_id), n, n if applied is None else int(applied), None, False, None)])

    return keep


class ProgressRecorder(StreamingQueryListener):
    """Records each progress report of the session's queries, with the rows that a watermark dropped, which no step can see.

    Add it with `spark.streams.addListener`. Queries have a table each, under the path, by their name or else their id.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names = spark, path, {}

    def of(self, name: str) -> Outcomes:
        return Outcomes(self.spark, f"{self.path}/{name}")

    def onQueryStarted(self, event: Any) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        before, after = ("; ".join(str(getattr(s, k)) for s in p.sources) for k in ("startOffset", "endOffset"))
        wrote, late = p.sink.numOutputRows, sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        row = (str(p.runId), p.batchId, "batch", before, after, p.numInputRows, wrote if wrote is not None and wrote >= 0 else p.numInputRows, late, False, None)
        self.of(p.name or str(p.id)).record([row])

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if event.exception is not None:
            self.of(self.names.get(str(event.id), str(event.id))).record([(str(event.runId), -1, "query", None, None, None, None, None, True, event.exception)])


def summary(outcomes: DataFrame) -> DataFrame:
    """(run, batches, read, applied, late, failures, last_reason) of each run."""
    return outcomes.groupBy("run").agg(
        F.countDistinct(F.when(F.col("batch_id") >= 0, F.col("batch_id"))).alias("batches"), *(F.sum(c).alias(c) for c in ("read", "applied", "late")), F.count_if("failed").alias("failures"), F.max_by("reason", F.when(F.col("failed"), F.col("entry"))).alias("last_reason")
    )
