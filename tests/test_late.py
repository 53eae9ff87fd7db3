"""Late rows, and watch lists whose sessions are dealt over shards."""

import datetime
import random

from pyspark.sql import functions as F

from foldspark.operators import bars, quotes
from foldspark.sources import feeds
from foldspark.streaming import late, watchlist

TICKS = "seq long, symbol string, price double, size long, ts string"


def test_late_rows_are_told_and_merged(spark, tmp_path):
    sent = []
    for k, hour in enumerate((1, 9, 10, 2, 11, 1)):  # the fourth and the sixth file come hours late
        rows = [(10 * k + n, "A", float(k), 1, f"2024-01-01 {hour:02d}:0{n}:00") for n in range(3)] + ([(0, "A", 0.0, 1, "2024-01-01 01:00:00")] if k == 4 else [])
        sent += rows
        spark.createDataFrame(rows, TICKS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(TICKS).parquet(str(tmp_path / "in/*"))
    of = late.LateBars(spark, "ts", "1 hour", "1 hour", str(tmp_path / "out"))
    for _ in range(2):  # the second start has nothing to do
        of.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.batch_id, r.seq) for r in of.late().collect()) == [(3, 30), (3, 31), (3, 32), (4, 0), (5, 50), (5, 51), (5, 52)]
    want = bars.ohlc(late.with_bar(spark.createDataFrame(sent, TICKS), "ts", "1 hour"))
    got = of.bars()
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count() == 5
    assert of.watermark() == datetime.datetime(2024, 1, 1, 10, 2)
    assert {(r.bar.hour, r.closed, r.late) for r in got.collect()} == {(1, True, 4), (2, True, 3), (9, True, 0), (10, False, 0), (11, False, 0)}
    of.step(spark.createDataFrame(sent[-3:], TICKS), 5)  # a replay
    assert of.late().count() == 7 and of.bars().agg(F.sum("volume")).first()[0] == 18


def test_shards_of_a_hot_symbol_deliver_the_same(spark, tmp_path):
    rng = random.Random(4)
    ticks = [(k, rng.choice("aaaaaaaab"), float(k)) for k in range(0, 120, 2)]
    watches = list({(s, i): (s, i, rng.choice(["A", "A", "b"]), rng.random() < 0.3) for s, i in ((rng.randint(0, 120), rng.randint(1, 9)) for _ in range(60))}.values())
    t = spark.createDataFrame(ticks, "seq long, symbol string, price double")
    w = spark.createDataFrame(watches, "seq long, session_id long, symbol string, unwatch boolean")
    t.coalesce(1).write.parquet(str(tmp_path / "t"))
    w.coalesce(1).write.parquet(str(tmp_path / "w"))
    want = sorted((r.session_id, r.symbol.upper(), r.seq, r.kind) for r in quotes.watchlist(t, w, width=8).collect())
    for shards in (1, 3):
        stream = watchlist.watchlist(feeds.read_changes(spark, str(tmp_path / "t")), feeds.read_changes(spark, str(tmp_path / "w")), shards)
        out = str(tmp_path / f"out{shards}")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp{shards}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted((r.session_id, r.key, r.seq, r.kind) for r in spark.read.parquet(out).collect()) == want and len(want) > 100
