"""Windows of n records and durable outcomes, over failures, restarts and any cut into files."""

from decimal import Decimal

import pytest

from foldspark.operators import bars
from foldspark.sources import feeds
from foldspark.streaming import incremental, outcomes, projections, windows

PRICES = [(10, 1), (11, 2), (12, 4), (13, 8), (14, 16), (15, 32)]
TICKS = [(7 + k, "NVDA", Decimal(p), s, "09:32") for k, (p, s) in enumerate(PRICES)]
SCHEMA = "seq long, symbol string, price decimal(18,6), size long, bar string"


def write(spark, rows, folder, n):
    for k in range(0, len(rows), n):
        spark.createDataFrame(rows[k : k + n], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("per_file", [2, 6])
def test_a_failure_reads_again_no_more_than_its_window(spark, tmp_path, per_file):
    """The fifth of six records fails, in windows of three: three records are read again, whatever the files."""
    write(spark, TICKS, tmp_path / "in", per_file)
    out, poisoned, seen = str(tmp_path / "out"), [True], []

    def handle(rows, number):
        incremental.apply(rows, number, f"{out}/bars", incremental.BARS)
        here = sorted(r.seq for r in rows.collect())
        if poisoned[0] and 11 in here:
            raise ValueError("poison")
        seen.append((number, here))

    def start(run):
        return windows.count_windows(feeds.read_changes(spark, str(tmp_path / "in")), "symbol", "seq", 3, handle, f"{out}/windows", str(tmp_path / "cp"), run)

    with pytest.raises(Exception, match="poison"):
        start("first").awaitTermination()
    of = windows.Windows(spark, "symbol", "seq", 3, handle, f"{out}/windows")
    assert seen == [(0, [7, 8, 9])] and [r.through for r in of.committed().collect()] == [9]
    poisoned[0] = False
    start("second").awaitTermination()
    assert seen == [(0, [7, 8, 9]), (1, [10, 11, 12])]
    row = incremental.read(spark, f"{out}/bars", incremental.BARS).first()
    assert (row.open, row.high, row.low, row.close, row.volume) == (10, 15, 10, 15, 63)
    told = [(r.run, r.unit, r.before, r.after, r.read, r.applied, r.failed) for r in of.outcomes.read().collect()]
    assert told == [("first", "NVDA", None, "9", 3, 3, False), ("first", "NVDA", "9", "9", 3, 0, True), ("second", "NVDA", "9", "12", 3, 3, False)]
    assert {r.run: (r.failures, r.applied) for r in outcomes.summary(of.outcomes.read()).collect()} == {"first": (1, 3), "second": (0, 3)}


def test_what_fills_no_window_waits(spark, tmp_path):
    rows = [(k, s, Decimal(k), 1, "b") for k in range(1, 8) for s in ("A", "B") if s == "A" or k < 5] + [(2, "A", Decimal(2), 1, "b")]
    write(spark, rows, tmp_path / "in", 4)
    seen = []
    stream = feeds.read_changes(spark, str(tmp_path / "in"))

    def handle(part, number):
        seen.append(sorted((r.symbol, r.seq) for r in part.collect()))

    windows.count_windows(stream, "symbol", "seq", 3, handle, str(tmp_path / "w"), str(tmp_path / "cp")).awaitTermination()
    of = windows.Windows(spark, "symbol", "seq", 3, handle, str(tmp_path / "w"))
    assert {r.symbol: r.through for r in of.committed().collect()} == {"A": 6, "B": 3}
    assert sorted(x for part in seen for x in part) == sorted({(r[1], r[0]) for r in rows if r[0] <= {"A": 6, "B": 3}[r[1]]})
    assert all(sum(s == shard for s, _ in part) in (0, 3) for part in seen for shard in "AB")
    of.flush()
    assert {r.symbol: r.through for r in of.committed().collect()} == {"A": 7, "B": 4} and seen[-1] == [("A", 7), ("B", 4)]
    of.flush()
    assert len(of.outcomes.read().where("not failed").collect()) == 5


def test_outcomes_outlive_restarts(spark, tmp_path):
    write(spark, [(k, "A", Decimal(k), 1, "b") for k in range(20)], tmp_path / "in", 1)
    down = {5, 12}

    def step(batch, batch_id):
        if batch_id in down:
            down.remove(batch_id)
            raise ValueError(f"down at {batch_id}")
        return incremental.apply(batch, batch_id, str(tmp_path / "out"), incremental.BARS) and batch.count()

    recorder = outcomes.ProgressRecorder(spark, str(tmp_path / "progress"))
    spark.streams.addListener(recorder)
    try:
        for run in ("r1", "r2", "r3"):
            stream = feeds.read_changes(spark, str(tmp_path / "in"))
            query = stream.writeStream.queryName("bars").foreachBatch(outcomes.recorded(step, str(tmp_path / "outcomes"), run)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            if run != "r3":
                with pytest.raises(Exception, match="down at"):
                    query.awaitTermination()
            else:
                query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(recorder)
    rows = outcomes.Outcomes(spark, str(tmp_path / "outcomes")).read().collect()
    assert [r.batch_id for r in rows] == [*range(6), *range(5, 13), *range(12, 20)]
    assert [(r.run, r.batch_id, r.reason) for r in rows if r.failed] == [("r1", 5, "down at 5"), ("r2", 12, "down at 12")]
    assert sum(r.applied for r in rows) == 20 and len(list((tmp_path / "outcomes/runs").iterdir())) < 20
    progress = recorder.of("bars").read().collect()
    assert sorted(r.batch_id for r in progress if not r.failed) == list(range(20)) and sum(r.failed for r in progress) == 2
    assert incremental.read(spark, str(tmp_path / "out"), incremental.BARS).first().volume == 20
