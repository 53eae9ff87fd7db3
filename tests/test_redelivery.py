"""Retries over batches and restarts, and claims that a failure releases."""

import os

from pyspark.sql import functions as F

from foldspark.operators import reactions
from foldspark.sources import feeds
from foldspark.streaming.redelivery import Redelivery, claimed

EVENTS = "tenant_id long, company string, plan string, correlation_id string, email string"


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_a_failed_event_comes_again_after_a_restart(spark, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    of = Redelivery(spark, reactions.welcome_email, str(tmp_path / "out"), max_attempts=3)

    def journal():
        return sorted((r.batch_id, r.correlation_id, r.attempt, r.outcome) for r in of.read("journal").collect())

    write(spark, [(1, "acme", "standard", "c1", "a@x"), (2, "bounce", "standard", "c2", "b@x")], EVENTS, source)
    of.start(feeds.read_changes(spark, str(source)), checkpoint).awaitTermination()
    assert journal() == [(0, "c1", 1, "done"), (0, "c2", 1, "retry")] and of.read("dead").count() == 0
    assert [(r.correlation_id, r.attempt) for r in of.read("retry").collect()] == [("c2", 2)]

    write(spark, [(3, "bounce too", "standard", "c3", "c@x")], EVENTS, source)
    down = [True]

    def react(events):
        if down[0]:
            raise ValueError("down")
        return reactions.welcome_email(events)

    failing = Redelivery(spark, react, str(tmp_path / "out"), max_attempts=3)
    query = failing.start(feeds.read_changes(spark, str(source)), checkpoint)
    try:
        query.awaitTermination()
    except Exception as e:
        assert "down" in str(e)
    assert journal() == [(0, "c1", 1, "done"), (0, "c2", 1, "retry")]
    down[0] = False
    failing.start(feeds.read_changes(spark, str(source)), checkpoint).awaitTermination()  # the batch comes again, with its retries
    assert journal()[2:] == [(1, "c2", 2, "retry"), (1, "c3", 1, "retry")]
    assert of.drain() == 2
    assert journal()[4:] == [(2, "c2", 3, "dead-letter"), (2, "c3", 2, "retry"), (3, "c3", 3, "dead-letter")]
    assert sorted((r.correlation_id, r.attempt) for r in of.read("dead").collect()) == [("c2", 3), ("c3", 3)]
    assert of.drain() == 0


def test_claims_are_released_by_failures(spark, tmp_path):
    flags = tmp_path / "flags"
    flags.mkdir()

    def effect(row):
        """Fails the first time for each body that says so; leaves a file for each success."""
        first = os.path.join(str(flags), "tried-" + row["body"])
        if row["body"].startswith("fail") and not os.path.exists(first):
            open(first, "w").close()
            if row["body"].endswith("!"):
                raise ValueError("failed")
            return False
        open(os.path.join(str(flags), f"done-{row['body']}-{row['delivery']}"), "w").close()
        return True

    rows = [[("t", "good", 1), ("t", "fail", 2), ("t", "fail!", 3)], [("t", "good", 4), ("t", "fail", 5), ("t", "fail!", 6), ("u", "good", 7)], [("t", "fail", 8), ("t", "fail!", 9), ("t", "good", 10)]]
    got = []
    for some in rows:  # a restart after each batch
        write(spark, some, "topic string, body string, delivery long", tmp_path / "in")
        stream = claimed(feeds.read_changes(spark, str(tmp_path / "in")), effect)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got.append({r.delivery: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    assert got[0] == {1: "done", 2: "failed", 3: "failed"}
    assert got[2] == got[0] | {4: "duplicate", 5: "done", 6: "done", 7: "done", 8: "duplicate", 9: "duplicate", 10: "duplicate"}
    assert sorted(f.name for f in flags.iterdir() if f.name.startswith("done")) == ["done-fail!-6", "done-fail-5", "done-good-1", "done-good-7"]


def test_claims_end_after_their_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for _ in range(2):
            write(spark, [("t", "x", 1)], "topic string, body string, delivery long", tmp_path / "in")
            stream = claimed(feeds.read_changes(spark, str(tmp_path / "in")), lambda row: True, time_to_live_ms=1)
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [r.outcome for r in spark.read.parquet(str(tmp_path / "out")).where(F.col("outcome").isNotNull()).collect()] == ["done", "done"]
