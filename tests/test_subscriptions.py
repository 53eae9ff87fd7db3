"""Late subscribers of a file log."""

import pytest

from foldspark.sources.subscriptions import Subscriptions

SCHEMA = "seq long, shard string"


def test_a_late_subscriber_sees_what_comes_after_it_registered(spark, tmp_path):
    log = str(tmp_path / "log")

    def write(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)

    def drain(name):
        stream = of.read(name)
        stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.shard or "", r.seq) for r in spark.read.parquet(str(tmp_path / name)).collect())

    of = Subscriptions(spark, str(tmp_path / "subscriptions"), log, "seq", "shard")
    write((1, "a"), (2, "a"), (7, "b"), (1, None))
    of.register("late")
    of.register("all", from_log=True)
    write((3, "a"), (8, "b"), (2, None))  # before the first query starts
    of.register("late")  # again: nothing changes
    assert drain("late") == [("", 2), ("a", 3), ("b", 8)]
    assert len(drain("all")) == 7
    write((4, "a"), (1, "c"))  # after a restart, and from a new shard
    assert drain("late") == [("", 2), ("a", 3), ("a", 4), ("b", 8), ("c", 1)]
    assert len(drain("all")) == 9
    with pytest.raises(LookupError):
        of.read("nobody")
