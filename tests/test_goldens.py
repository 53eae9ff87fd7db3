"""Small worked cases of the operators."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspark.functions import ranges
from foldspark.operators import bars, ledger, logs, orders, outbox, positions, quotes, reactions, risk, saga, views

EVENTS = "stream_id string, version long, event_type string, payload string, pence long"


def account(*moves):
    rows = [("acc", 1, ledger.OPENED, '{"account_id":"acc","holder":"h","currency":"GBP"}', 0)]
    for k, (kind, pence) in enumerate(moves, 2):
        rows.append(("acc", k, kind, f'{{"pence":{pence}}}', pence))
    return rows


def test_bars_do_not_care_for_order_or_repetition(spark):
    ticks = [(7 + k, "NVDA", D(10 + k), 1 << k, "09:32") for k in range(6)]
    schema = "seq long, symbol string, price decimal(18,6), size long, bar string"
    want = bars.ohlc(spark.createDataFrame(ticks, schema)).collect()
    for seed in range(3):
        again = [*ticks, *random.Random(seed).choices(ticks, k=7)]
        random.Random(seed).shuffle(again)
        assert bars.ohlc(spark.createDataFrame(again, schema)).collect() == want
    row = want[0]
    assert (row.open, row.high, row.low, row.close, row.volume, row.sequences) == (10, 15, 10, 15, 63, list(range(7, 13)))
    twice = spark.createDataFrame([*ticks, ticks[3]], schema)
    assert bars.ohlc(twice, dedupe=False).first().volume == 71
    assert bars.inflation(twice).first().naive_volume == 71
    assert bars.rebuild_diff(bars.ohlc(twice), twice).isEmpty()


def test_balances_and_snapshots(spark):
    rows = account((ledger.DEPOSITED, 10_000), (ledger.WITHDRAWN, 2_500), (ledger.WITHDRAWN, 1_000), (ledger.DEPOSITED_V1, 5_000))
    events = spark.createDataFrame(rows, EVENTS)
    now = ledger.balances(events).first()
    assert (now.exists, now.balance, now.version, now.events_read) == (True, 11_500, 5, 5)
    assert ledger.as_of(events, 2).first().balance == 10_000
    assert ledger.as_of(events, 0).first().balance == ledger.as_of(events, 99).first().balance == 11_500
    assert ledger.history(events, "acc").where("version = 5").first().event_type == ledger.DEPOSITED_V1
    assert ledger.decode(ledger.upcast(events)).where("version = 5").first().currency == "GBP"
    snap = ledger.snapshot(events)
    more = spark.createDataFrame([*rows, ("acc", 6, ledger.DEPOSITED, "{}", 100)], EVENTS)
    fast, slow = ledger.current(more, snap).first(), ledger.balances(more).first()
    assert (fast.balance, fast.version, fast.events_read, slow.events_read) == (11_600, 6, 1, 6)
    assert ledger.current(more, snap.limit(0)).first().balance == slow.balance
    reopened = spark.createDataFrame([*rows, ("acc", 6, ledger.OPENED, "{}", 0), ("acc", 7, ledger.DEPOSITED, "{}", 5), ("acc", 8, "odd:type", "{}", 9)], EVENTS)
    assert ledger.balances(reopened).first().balance == ledger.current(reopened, snap).first().balance == 5
    assert [r.balance for r in ledger.balance_history(reopened).orderBy("version").collect()][-3:] == [0, 5, 5]
    assert not ledger.balances(spark.createDataFrame([("x", 1, ledger.DEPOSITED, "{}", 5)], EVENTS)).first().exists


def test_commands(spark):
    events = spark.createDataFrame(account((ledger.DEPOSITED, 10_000), (ledger.WITHDRAWN, 2_500)), EVENTS)
    commands = [
        ("acc", 1, "withdraw", 1_000, 3, "h"), ("acc", 2, "withdraw", 1_000, 3, "h"), ("acc", 3, "withdraw", 999_999, 0, "h"), ("acc", 4, "deposit", 0, 0, "h"),
        ("acc", 5, "open", None, 0, "h"), ("new", 6, "deposit", 5, 0, "h"), ("new", 7, "open", None, 0, " "), ("new", 8, "open", None, 0, "h"), ("new", 9, "deposit", 5, 1, "h"),
    ]
    got = ledger.adjudicate(spark.createDataFrame(commands, "account_id string, arrival long, kind string, pence long, expected_version long, holder string"), events).orderBy("arrival").collect()
    assert [(r.status, r.error, r.new_balance, r.new_version) for r in got] == [
        ("ok", None, 6_500, 4), ("conflict", "version", 6_500, 4), ("validation-error", "insufficient-funds", 6_500, 4), ("validation-error", "pence", 6_500, 4),
        ("conflict", "exists", 6_500, 4), ("not-found", "account", 0, 0), ("validation-error", "blank", 0, 0), ("ok", None, 0, 1), ("ok", None, 5, 2),
    ]
    assert ledger.accepted_events(spark.createDataFrame(got)).count() == 3


def test_view_and_stub(spark):
    tenants = spark.createDataFrame([("t", "acme", 1), ("t", "acme 2", 2)], "tenant_id string, company string, version long")
    users = spark.createDataFrame([("u", "t", "a@x")] * 4 + [("v", "s", "b@x")], "user_id string, tenant_id string, email string")
    view = {r.tenant_id: r for r in views.tenant_users(tenants, users).collect()}
    assert (view["t"].company, view["t"].user_count) == ("acme 2", 1)
    assert (view["s"].company, view["s"].tenant_version, view["s"].user_count) == ("", 0, 1)


def test_outbox(spark):
    deliveries = spark.createDataFrame([("c", str(k)) for k in (1, 2, 3, 4, 1, 2, 3)], "customer string, event_id string")
    row = outbox.delivery_stats(deliveries, "customer").first()
    assert (row.events, row.duplicates) == (4, 3)
    orders_ = spark.createDataFrame([("a",), ("b",)], "order_id string")
    gap = outbox.reconcile(orders_, spark.createDataFrame([("a",), ("z",)], "order_id string")).collect()
    assert sorted((r.order_id, r.kind) for r in gap) == [("b", "order_without_event"), ("z", "event_without_order")]
    odd = spark.createDataFrame([(1, "INSERT", {"order_id": "o", "customer": "c", "total": "x"}), (2, "INSERT", {"order_id": "o"}), (3, None, None), (4, "INSERT", {"order_id": "o", "customer": "c", "total": "2.5"})], "seq long, op string, new_image map<string,string>")
    assert [r.seq for r in outbox.inserts(odd).collect()] == [4]
    assert sorted((r.seq, r.reason) for r in outbox.skipped(odd).collect())[:2] == [(1, "bad total"), (2, "missing attribute")]


def test_reactions(spark):
    people = [(7, "acme", "a@x.io", "standard", "1"), (8, "bounce-corp", "b@x.io", "standard", "2"), (9, "big", "c@x.io", "enterprise", "3")]
    events = spark.createDataFrame(people, "tenant_id long, company string, email string, plan string, correlation_id string")
    rows = reactions.journal(events).collect()
    told = {(r.reaction, r.correlation_id): r.what for r in rows}
    assert [told[n, "1"] for n in reactions.REGISTRY] == ["signup: acme on standard", "warmed 7", "trial started for 7 (14 days)", "welcomed a@x.io"]
    assert told["welcome-email", "2"] == "FAILED to email b@x.io"
    by = lambda c: sorted((r.reaction, r.status) for r in rows if r.correlation_id == c)
    assert by("1") == [(n, "ok") for n in ("analytics", "cache-warmer", "trial-clock", "welcome-email")]
    assert ("welcome-email", "FAILED") in by("2") and len(by("2")) == 4
    assert [n for n, _ in by("3")] == ["analytics", "cache-warmer", "welcome-email"]
    missing = {r.reaction: r.missing for r in reactions.trace(events, reactions.journal(events), list(reactions.REGISTRY)).collect()}
    assert missing == {"analytics": 0, "cache-warmer": 0, "trial-clock": 1, "welcome-email": 0}
    tries = spark.createDataFrame([("t", "b", 1, "FAILED"), ("t", "b", 2, "ok"), ("t", "b", 3, "ok")], "topic string, body string, delivery long, status string")
    assert [r.delivery for r in reactions.dedupe(tries).collect()] == [2]


def test_retries_go_by_event_and_not_by_correlation(spark):
    rows = [("e1", "acme", "a@x.io", "shared"), ("e2", "bounce-a", "b@x.io", "shared"), ("e3", "bounce-b", "c@x.io", None), (None, "bounce-c", "d@x.io", None)]
    events = spark.createDataFrame(rows, "event_id string, company string, email string, correlation_id string")
    got = sorted(((r.event_id, r.attempt, r.outcome) for r in reactions.with_retries(events, reactions.welcome_email).collect()), key=repr)
    assert got == sorted([("e1", 1, "done"), *((e, n, o) for e in ("e2", "e3", None) for n, o in ((1, "retry"), (2, "dead-letter")))], key=repr)
    without = reactions.with_retries(events.drop("event_id"), reactions.welcome_email).collect()
    assert sorted((r.what, r.outcome) for r in without) == sorted([("welcomed a@x.io", "done"), *((f"FAILED to email {c}@x.io", o) for c in "bcd" for o in ("retry", "dead-letter"))])


def test_events_are_cast_along_chains(spark):
    add = lambda name: lambda payload: F.concat(payload, F.lit(name))
    casters = {"a:v1": ("a:v2", add("2")), "a:v2": ("a", add("3")), "b:v1": ("b", add("x"))}
    events = spark.createDataFrame([("a:v1", "p"), ("a:v2", "p"), ("a", "p"), ("b:v1", "p"), ("c", None)], "event_type string, payload string")
    assert [tuple(r) for r in ledger.upcast(events, casters).collect()] == [("a", "p23"), ("a", "p3"), ("a", "p"), ("b", "px"), ("c", None)]
    assert ledger.hops(casters) == 2 and ledger.hops({}) == 0
    with pytest.raises(ValueError, match="circle"):
        ledger.upcast(events, {"a": ("b", add("")), "b": ("a", add(""))})


def test_signups(spark):
    rows = [(1, "acme", "standard", "a@x"), (2, "acme", "platinum", "a@x"), (3, "acme", "Standard", "nope"), (4, "sticky-corp", "standard", "nope"), (5, " ", "gold", None)]
    got = {r.saga_id: r for r in saga.evaluate_signups(spark.createDataFrame(rows, "saga_id long, company string, plan string, email string")).collect()}
    assert [(got[k].outcome, got[k].failed_stage) for k in (1, 2, 3, 4)] == [("Succeeded", None), ("RolledBack", 0), ("RolledBack", 1), ("PartiallyRolledBack", 1)]
    assert got[4].orphans == "tenant" and got[5].failed_step == "tenant"


def test_allocation_and_orders(spark):
    requests = spark.createDataFrame([("g", 1, 3), ("G", 2, 4), ("g", 3, 2), ("x", 1, 1)], "sku string, arrival long, quantity int")
    stock = spark.createDataFrame([("G", 5)], "sku string, stock long")
    got = orders.allocate(requests, stock).orderBy("sku", "arrival").collect()
    assert sorted((r.arrival, r.status, r.remaining) for r in got if r.sku != "x") == [(1, "ok", 2), (2, "conflict", 2), (3, "ok", 0)]
    assert [r.status for r in got if r.sku == "x"] == ["not-found"]
    asked = spark.createDataFrame([("g", 1, "Alice", 3, D(2)), ("g", 2, "eve", 1, D(2)), ("g", 3, "bob", 9, D(2)), ("g", 4, "bob", 0, D(2)), ("g", 5, "bob", 2, D(0)), ("g", 6, "bob", 2, D(1))], "sku string, arrival long, customer string, quantity int, unit_price decimal(18,2)")
    names = spark.createDataFrame([("alice",), ("BOB",)], "customer string")
    out = orders.place(asked, names, stock).orderBy("arrival").collect()
    assert [(r.status, r.charged, r.refunded) for r in out] == [("ok", True, False), ("not-found", False, False), ("conflict", True, True), ("validation-error", False, False), ("validation-error", False, False), ("ok", True, False)]
    again = spark.createDataFrame([("c", 1), ("c", 2), ("z", 1)], "charge_id string, arrival long")
    assert sorted((r.charge_id, r.arrival, r.refunded) for r in orders.refunds(again, again.where("charge_id = 'c'")).collect()) == [("c", 1, True), ("c", 2, False), ("z", 1, False)]


def test_risk_keeps_coverage_apart(spark):
    trades = [("A", 1, "nvda", "Buy", D(2), D(5)), ("A", 2, "WEIRDCO", "Buy", D(1), D(1)), ("B", 1, "NVDA", "Sell", D(1), D(7))]
    schema = "book string, version long, symbol string, side string, quantity decimal(18,2), price decimal(18,2)"
    frame = spark.createDataFrame([*trades, trades[0]], schema)
    marks = spark.createDataFrame([("NVDA", D(10))], "symbol string, mid decimal(18,2)")
    books = risk.shard_books(spark.createDataFrame([(1, "A"), (2, "B"), (3, "none")], "pos long, book string"), 1)
    row = risk.run(books, frame, marks).first()
    assert (row.market_value, row.realized_cash, row.total, row.valued, row.shards) == (10, -4, 6, 2, 3)
    assert row.is_complete and not row.is_fully_priced and row.unpriced_symbols == 1 and len(row.unpriced) == 1 and row.failed == []
    row = risk.run(books, frame, marks, spark.createDataFrame([("A",)], "book string")).first()
    assert (row.failed_shards, row.is_complete, row.is_fully_priced, row.market_value) == (1, False, True, -10)
    names = spark.createDataFrame([(1, 1, " a "), (1, 2, ""), (1, 3, "A"), (1, 4, "b")], "request_id long, pos long, book string")
    assert [r.book for r in risk.normalized_books(names).orderBy("pos").collect()] == ["a", "b"]
    head = spark.createDataFrame([("A", 2)], "book string, version long")
    booked = positions.book(spark.createDataFrame([("A", 9, "X", "Buy", D(1), D(1)), ("A", 8, "X", "Hold", D(1), D(1))], schema).drop("version").withColumn("n", F.lit(1)), head, ["n"])
    assert [r.version for r in booked.collect()] == [3]


def test_greeks(spark):
    row = quotes.enrich(spark.createDataFrame([("X", 100.0)], "symbol string, mid double")).first()
    assert row.delta == pytest.approx(0.53256, abs=2e-6) and row.gamma == pytest.approx(0.055476, abs=2e-6)
    assert row.vega == pytest.approx(0.113992, abs=2e-6) and row.theta == pytest.approx(-0.053002, abs=2e-6)
    assert (row.bid, row.ask) == (99.98, 100.02)


def test_watchlist_and_gaps(spark):
    ticks = spark.createDataFrame([(s, "ab"[s % 2], D(s)) for s in range(0, 40, 1) if s != 11], "seq long, symbol string, price decimal(18,2)")
    watches = spark.createDataFrame([(10, 1, "A", False), (12, 1, "a", False), (20, 1, "a", True), (21, 1, "A", True), (30, 1, "a", False), (5, 2, "none", False)], "seq long, session_id long, symbol string, unwatch boolean")
    got = quotes.watchlist(ticks, watches, width=4).collect()
    assert sorted((r.start, r.seq) for r in got if r.kind == "tick") == [(10, s) for s in (12, 14, 16, 18)] + [(30, s) for s in (32, 34, 36, 38)]
    assert sorted((r.start, r.seq) for r in got if r.kind == "snapshot") == [(10, 10), (30, 30)]
    assert quotes.gaps(ticks.where("symbol = 'b'")).where("missing > 1").first().missing == 3


def test_logs(spark):
    log = spark.createDataFrame([(k, "s") for k in range(1, 8)], "seq long, shard string")
    assert [r.seq for r in logs.read_after(log, 2, 3).collect()] == [3, 4, 5]
    windows = logs.count_windows(log, 3, "shard").orderBy("window_no").collect()
    assert [(r.records, r.first_seq, r.last_seq) for r in windows] == [(3, 1, 3), (3, 4, 6), (1, 7, 7)]
    copies = spark.createDataFrame([(1, 0), (2, 3), (3, 99)], "seq long, times int")
    assert {r.seq: r["count"] for r in logs.redeliver(copies, "times").groupBy("seq").count().collect()} == {1: 1, 2: 3, 3: 10}
    numbered = logs.assign_sequence(log.withColumnRenamed("seq", "at"), 100, ["at"]).orderBy("at").collect()
    assert [r.seq for r in numbered] == list(range(101, 108))


def test_ranges_number_as_one_window_does(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(200) if k % 40 else None, k) for k in range(700)]
    frame = spark.createDataFrame(rows, "shard string, seq long, k long")
    for by in ("shard", None):
        window = Window.partitionBy(F.lit(0) if by is None else by).orderBy("seq", "k")
        want = frame.withColumn("n", F.row_number().over(window))
        got = ranges.with_row_number(frame, "n", ["seq", "k"], by=by, range_rows=30)
        assert sorted(want.collect(), key=repr) == sorted(got.select(want.columns).collect(), key=repr)
    cut = ranges.with_ranges(frame, "seq", 30).groupBy("_range").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("_range").collect()
    assert len(cut) > 15 and max(r.n for r in cut) < 90 and all(a.high < b.low for a, b in zip(cut[1:], cut[2:], strict=False))
    assert sorted(map(tuple, quotes.gaps(frame.withColumnRenamed("shard", "symbol"), 30).collect()), key=repr) == sorted(map(tuple, quotes.gaps(frame.withColumnRenamed("shard", "symbol")).collect()), key=repr)
    few, many = (logs.count_windows(frame, 3, "shard", n).collect() for n in (30, 10_000))
    assert sorted(few, key=repr) == sorted(many, key=repr)
    assert ranges.with_row_number(frame.limit(0), "n", ["seq"]).count() == 0


def test_watchlist_width_changes_nothing(spark):
    draw = random.Random(3)
    ticks = spark.createDataFrame([(s, draw.choice(["a", "A", "b"]), D(s)) for s in range(1, 400, 2)], "seq long, symbol string, price decimal(18,2)")
    watches = spark.createDataFrame([(2 * k, draw.randrange(4), draw.choice("abc"), draw.random() < 0.4) for k in range(150)], "seq long, session_id long, symbol string, unwatch boolean")
    wide, narrow = (sorted(quotes.watchlist(ticks, watches, width=w).collect()) for w in (None, 7))
    brute, watching = [], {}
    price = sorted((r.seq, r.symbol) for r in ticks.collect())
    changes = sorted((r.seq, r.session_id, r.symbol.upper(), r.unwatch) for r in watches.collect())
    for at, session, key, off in changes:
        if off:
            watching.pop((session, key), None)
        elif (session, key) not in watching:
            watching[session, key] = at
            end = min((c[0] for c in changes if c[0] > at and c[1] == session and c[2] == key and c[3]), default=10**9)
            mine = [t for t in price if t[1].upper() == key]
            brute += [(session, s, at, q, "tick") for q, s in mine if at < q < end]
            brute += [(session, s, at, q, "snapshot") for q, s in [t for t in mine if t[0] <= at][-1:]]
    assert [tuple(r) for r in wide] == [tuple(r) for r in narrow] == sorted(brute)
    assert quotes.watchlist(ticks.limit(0), watches).count() == 0 and quotes.watchlist(ticks, watches.limit(0)).count() == 0


def test_many_unpriced_symbols_are_named_once(spark):
    n = 50_000
    deliveries = spark.range(2 * n).select(F.concat(F.lit("B"), F.col("id") % 7).alias("book"), "id", F.concat(F.when(F.col("id") < n, "s").otherwise("S"), F.lpad((F.col("id") % n).cast("string"), 6, "0")).alias("symbol"))
    deliveries = deliveries.select("book", F.col("id").alias("version"), "symbol", F.lit("Buy").alias("side"), F.lit(D(1)).cast("decimal(18,2)").alias("quantity"), F.lit(D(2)).cast("decimal(18,2)").alias("price"))
    books = risk.shard_books(spark.createDataFrame([(k, f"B{k}") for k in range(7)], "pos long, book string"), 2)
    marks = spark.createDataFrame([("S000001", D(3))], "symbol string, mid decimal(18,4)")
    row = risk.run(books, deliveries, marks, spark.createDataFrame([("B6",)], "book string")).first()
    fine = [("S" if (k + n) % 7 != 6 else "s") + f"{k:06d}" for k in range(n) if k != 1 and (k % 7 != 6 or (k + n) % 7 != 6)]
    assert row.unpriced == fine and row.unpriced_symbols == len(fine) and row.failed == ["shard-3"]
    assert row.shards == 4 and row.failed_shards == 1 and row.realized_cash == -2 * sum(1 for k in range(2 * n) if k % 7 != 6)


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_watch_counts_are_the_watch_lists(spark, width):
    rng = random.Random(width)
    ticks = [(rng.randint(0, 60), rng.choice("abc"), float(k)) for k in range(150)]  # some seq twice
    watches = [(rng.randint(0, 60), rng.randint(1, 6), rng.choice(["A", "b", "C", "none"]), rng.random() < 0.4) for _ in range(60)]
    watches = list({(w[0], w[1], w[2]): w for w in watches}.values())
    t = spark.createDataFrame(ticks, "seq long, symbol string, price double")
    w = spark.createDataFrame(watches, "seq long, session_id long, symbol string, unwatch boolean")
    listed = quotes.watchlist(t, w, width=8).groupBy("session_id", "symbol", "start", "kind").agg(F.count("*").alias("ticks"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    counted = quotes.watch_counts(t, w, width)
    assert sorted(counted.collect()) == sorted(listed.select(counted.columns).collect()) and counted.count() > 20
    assert quotes.watch_counts(t.limit(0), w, width).count() == 0 and quotes.watch_counts(t, w.limit(0), width).count() == 0


def test_shard_partials_fold_priced_rows_apart_from_names(spark):
    """Spellings of a symbol are one name in a shard, priced rows and an unknown book give none, and a failed book fails its shard."""
    trades = [("A", 1, "x", "Buy", 2, 5), ("A", 2, "X", "Sell", 1, 5), ("A", 3, "gone", "Buy", 1, 1), ("B", 1, "GONE", "Buy", 3, 1), ("B", 2, "x", "Buy", 1, 7), ("C", 1, "other", "Buy", 1, 1)]
    deliveries = spark.createDataFrame(trades + trades[:2], "book string, version long, symbol string, side string, quantity int, price int")
    deliveries = deliveries.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("quantity", "price")})
    marks = spark.createDataFrame([("X", "10.50"), ("OTHER", None)], "symbol string, mid string").withColumn("mid", F.col("mid").cast("decimal(18,2)"))
    sharded = spark.createDataFrame([("A", "s0"), ("B", "s0"), ("C", "s1"), ("nobody", "s1"), ("nowhere", "s2")], "book string, shard string")
    parts = {r.shard: r for r in risk.shard_partials(sharded, positions.project(deliveries), marks, spark.createDataFrame([("C",)], "book string")).collect()}
    assert set(parts) == {"s0", "s1", "s2"}
    first, second, third = parts["s0"], parts["s1"], parts["s2"]
    # x is held as 2 and 1 in two books, X as -1: 21 + 10.5 - 10.5; cash is -10 + 5 - 1 - 3 - 7
    assert (float(first.market_value), float(first.realized_cash), first.valued, first.unpriced, first.failed) == (21.0, -16.0, 3, ["GONE"], False)
    assert (float(second.market_value), float(second.realized_cash), second.valued, second.unpriced, second.failed) == (0.0, -1.0, 0, ["other"], True)
    assert (float(third.market_value), float(third.realized_cash), third.valued, third.unpriced, third.failed) == (0.0, 0.0, 0, [], False)
