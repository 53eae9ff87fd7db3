"""Streaming forms against the batch operators, with failures and restarts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foldspark.operators import bars, outbox, positions, quotes, views
from foldspark.sources import feeds, sinks
from foldspark.streaming import fanout, incremental, projections, watchlist

PRICES = [(10, 1), (11, 2), (12, 4), (13, 8), (14, 16), (15, 32)]
TICKS = [(7 + k, "NVDA", Decimal(p), s, "09:32") for k, (p, s) in enumerate(PRICES)]
SCHEMA = "seq long, symbol string, price decimal(18,6), size long, bar string"


def write_files(spark, rows, schema, folder, n):
    for k in range(0, len(rows), n):
        spark.createDataFrame(rows[k : k + n], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_bars_survive_a_failure_in_the_middle(spark, tmp_path):
    write_files(spark, TICKS, SCHEMA, tmp_path / "in", 3)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    poisoned = [True]

    def poison(batch, batch_id):
        if batch_id == 1 and poisoned[0]:
            part = incremental.BARS.parts["bars"]
            incremental.stores(spark, out, incremental.BARS)["bars"].append(part.partial(batch.where("seq = 10")), batch_id)
            raise ValueError("poison")

    stream = feeds.read_changes(spark, str(tmp_path / "in"))
    query = projections.tick_bars(stream, out, checkpoint, poison)
    with pytest.raises(Exception, match="poison"):
        query.awaitTermination()
    report = projections.batch_report(spark, query).collect()
    assert report[-1].failed and not report[0].failed and "poison" in report[-1].reason
    assert report[0].checkpoint_before != report[0].checkpoint_after and report[-1].checkpoint_before == report[-1].checkpoint_after and report[-1].applied == 0
    assert incremental.read(spark, out, incremental.BARS).first().volume == 7
    poisoned[0] = False
    projections.tick_bars(stream, out, checkpoint, poison).awaitTermination()
    row = incremental.read(spark, out, incremental.BARS).first()
    assert (row.open, row.high, row.low, row.close, row.volume) == (10, 15, 10, 15, 63)
    naive = spark.createDataFrame([*TICKS, TICKS[3]], SCHEMA)
    assert bars.ohlc(naive, dedupe=False).first().volume == 71
    assert bars.ohlc(naive).first().volume == 63


def test_positions_and_relay_equal_their_batch_forms(spark, tmp_path):
    trades = [("B", v, f"P{v % 3}", "Buy" if v % 2 else "Sell", Decimal(v), Decimal(2)) for v in range(1, 13)]
    rows = [*trades, *trades[:4]]
    schema = "book string, version long, symbol string, side string, quantity decimal(18,2), price decimal(18,2)"
    write_files(spark, rows, schema, tmp_path / "in", 5)
    projections.book_positions(feeds.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    live = incremental.read(spark, str(tmp_path / "out"), incremental.POSITIONS)
    assert live.exceptAll(positions.project(spark.createDataFrame(rows, schema))).isEmpty() and live.count() == 3

    changes = [(k, "INSERT" if k % 3 else "MODIFY", {"order_id": f"o{k}", "customer": "c", "total": "1.5" if k % 4 else "x"}) for k in range(20)]
    write_files(spark, changes, "seq long, op string, new_image map<string,string>", tmp_path / "cdc", 7)
    stream = feeds.read_changes(spark, str(tmp_path / "cdc"))
    down = [True]

    def publish(events, batch_id):
        sinks.append_idempotent(events, batch_id, str(tmp_path / "pub"))
        if batch_id == 1 and down[0]:
            raise ValueError("broker is down")

    with pytest.raises(Exception, match="broker"):
        projections.relay(stream, "", str(tmp_path / "cp2"), publish).awaitTermination()
    down[0] = False
    projections.relay(stream, "", str(tmp_path / "cp2"), publish).awaitTermination()
    got = sinks.read_appended(spark, str(tmp_path / "pub")).select("event_id", "order_id", "customer", "total")
    assert sorted(got.collect()) == sorted(outbox.to_order_created(spark.createDataFrame(changes, "seq long, op string, new_image map<string,string>")).collect())


def test_tenant_view_equals_rebuild(spark, tmp_path):
    tenants = spark.createDataFrame([(1, "a", 1, "tenant:created"), (1, "b", 2, "tenant:renamed"), (2, "c", 1, "tenant:created"), (9, "z", 1, "odd:topic")], "tenant_id long, company string, version long, topic string")
    users = spark.createDataFrame([("u1", 1, "x@x"), ("u2", 1, "y@x"), ("u3", 7, "z@x"), ("u1", 1, "x@x")], "user_id string, tenant_id long, email string")
    logs = views.record(tenants, users)
    records = views.replay(*logs.items()).withColumn("tenant_id", F.get_json_object("body", "$.tenant_id").cast("long"))
    for k in (1, 0):
        records.where(F.pmod(F.hash("body"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    projections.tenant_view(feeds.read_changes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    live = incremental.read(spark, str(tmp_path / "out"), incremental.TENANTS)
    assert views.diff(live, views.rebuild(logs)).isEmpty() and views.diff(live, views.rebuild(logs, reverse=True)).isEmpty()
    stub = live.where("tenant_id = 7").first()
    assert (stub.company, stub.tenant_version, stub.user_count) == ("", 0, 1)
    assert live.where("tenant_id = 1").first().user_count == 2


def test_dedupe_and_rolling_bars(spark, tmp_path):
    rows = [(k, "A", float(k), 1, f"2024-01-01 00:{k % 60:02d}:00") for k in range(30)]
    write_files(spark, [*rows, *rows[:10]], "seq long, symbol string, price double, size long, ts string", tmp_path / "in", 10)
    stream = feeds.read_changes(spark, str(tmp_path / "in"), per_batch=10)
    query = projections.rolling_bars(stream, "ts", "10 minutes").writeStream.format("memory").queryName("rolling").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.volume for r in spark.table("rolling").orderBy("bar.start").collect()] == [10, 10, 10]
    bounded = projections.dedupe(stream.withColumn("ts", F.col("ts").cast("timestamp")), ["seq"], "ts", "1 hour")
    query = bounded.writeStream.format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("bounded").count() == 30


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    for k, hour in enumerate((1, 9, 10, 2, 11)):  # the fourth file comes eight hours late
        rows = [(10 * k + n, "A", 1.0, 1, f"2024-01-01 {hour:02d}:0{n}:00") for n in range(3)]
        spark.createDataFrame(rows, "seq long, symbol string, price double, size long, ts string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("seq long, symbol string, price double, size long, ts string").parquet(*[str(tmp_path / "in/*")])
    query = projections.rolling_bars(stream, "ts", "1 hour", "1 hour").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    report = projections.batch_report(spark, query)
    assert report.agg(F.sum("late")).first()[0] == 3
    assert {r.bar.start.hour for r in spark.table("late").collect()} <= {1, 9, 10, 11}


def test_broker_records_round_trip(spark):
    rows = spark.createDataFrame([(1, "a", Decimal("1.50")), (2, None, None)], "seq long, name string, total decimal(18,2)")
    sent = feeds.encode_records(rows, "seq")
    assert [r.key for r in sent.orderBy("key").collect()] == ["1", "2"]
    back = feeds.decode_records(sent.union(spark.createDataFrame([("3", "no json")], "key string, value string")), rows.schema)
    got = {r.seq: (r.name, r.total, r._bad) for r in back.collect()}
    assert got == {1: ("a", Decimal("1.50"), None), 2: (None, None, None), None: (None, None, "no json")}


def test_reactions_are_independent(spark, tmp_path):
    events = [(1, "acme", "standard", "c1", "a@x.io"), (2, "bounce-corp", "standard", "c2", "b@x.io"), (3, "big", "enterprise", "c3", "c@x.io")]
    write_files(spark, events, "tenant_id long, company string, plan string, correlation_id string, email string", tmp_path / "in", 2)
    stream = feeds.read_changes(spark, str(tmp_path / "in"))
    for query in fanout.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).values():
        query.awaitTermination()
    mail = sinks.read_appended(spark, str(tmp_path / "out/welcome-email/journal"))
    assert sorted((r.correlation_id, r.attempt, r.outcome) for r in mail.collect()) == [("c1", 1, "done"), ("c2", 1, "retry"), ("c2", 2, "dead-letter"), ("c3", 1, "done")]
    assert sorted(r.correlation_id for r in sinks.read_appended(spark, str(tmp_path / "out/trial-clock/journal")).collect()) == ["c1", "c2"]


def test_grouped_batches_keep_each_keys_order(spark, tmp_path):
    write_files(spark, TICKS[::-1], SCHEMA, tmp_path / "in", 6)
    projections.grouped_batches(feeds.read_changes(spark, str(tmp_path / "in")), "symbol", "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sinks.read_appended(spark, str(tmp_path / "out")).orderBy("place").collect()
    assert [r.seq for r in got] == list(range(7, 13))


def test_a_step_runs_on_each_key_or_the_whole_batch_comes_again(spark, tmp_path):
    write_files(spark, TICKS, SCHEMA, tmp_path / "in", 6)
    stream, down = feeds.read_changes(spark, str(tmp_path / "in")), [True]

    def step(placed):
        if down[0]:
            raise ValueError("poison")
        return placed.groupBy("symbol").agg(F.max("place").alias("rows"), F.sum("size").alias("volume"))

    def start():
        projections.grouped_batches(stream, "symbol", "seq", str(tmp_path / "out"), str(tmp_path / "cp"), step).awaitTermination()

    with pytest.raises(Exception, match="poison"):
        start()
    assert sinks.read_appended(spark, str(tmp_path / "out")) is None
    down[0] = False
    start()
    assert [(r.rows, r.volume) for r in sinks.read_appended(spark, str(tmp_path / "out")).collect()] == [(6, 63)]


def test_view_replays_and_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "view")
    first = spark.createDataFrame([(k, 1) for k in range(40)] + [(None, 1)], "k int, v int")
    sinks.upsert_view(first, 0, path, ["k"], 8)
    for version in (1, 2, 2, 3):
        sinks.upsert_view(spark.createDataFrame([(3, 10 * version), (50 + version, 1), (None, version)], "k int, v int"), version, path, ["k"], 8)
    got = {r.k: r.v for r in sinks.read_view(spark, path).collect()}
    assert got == {k: 1 for k in range(40)} | {None: 3, 3: 30, 51: 1, 52: 1, 53: 1}
    versions = sinks._versions(spark, path)
    assert max(map(len, versions.values())) == 2 and [0] in versions.values()
    sinks.upsert_view(first.limit(0), 4, path, ["k"], 8)
    assert sinks.read_view(spark, path).count() == 44


def test_watchlist_stream_equals_batch(spark, tmp_path):
    ticks = [(k, "abc"[k % 3], float(k)) for k in range(0, 60, 2)]
    watches = [(9, 1, "A", False), (11, 1, "a", False), (31, 1, "A", True), (5, 2, "b", False), (1, 3, "zz", False), (41, 1, "a", False)]
    t = spark.createDataFrame(ticks, "seq long, symbol string, price double")
    w = spark.createDataFrame(watches, "seq long, session_id long, symbol string, unwatch boolean")
    t.coalesce(1).write.parquet(str(tmp_path / "t"))
    w.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = watchlist.watchlist(feeds.read_changes(spark, str(tmp_path / "t")), feeds.read_changes(spark, str(tmp_path / "w")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.session_id, r.seq, r.kind) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.session_id, r.seq, r.kind) for r in quotes.watchlist(t, w, width=8).collect())
    assert got == want and want


def test_folds_without_partial_states_read_their_log_again(spark, tmp_path):
    write_files(spark, [*TICKS, *TICKS[:2]], SCHEMA, tmp_path / "in", 3)
    out = str(tmp_path / "out")
    projections.project(feeds.read_changes(spark, str(tmp_path / "in")), ["symbol", "bar"], bars.ohlc, out, str(tmp_path / "cp")).awaitTermination()
    assert sinks.read_view(spark, f"{out}/view").collect() == bars.ohlc(spark.createDataFrame(TICKS, SCHEMA)).collect()
