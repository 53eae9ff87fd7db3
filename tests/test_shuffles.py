"""How often the rows of a fold are shuffled, sorted and read, and that the partitions follow the rows."""

import pytest

from foldspark.functions.ranges import dealt
from foldspark.operators import ledger, positions, risk
from foldspark.plans import registry
from foldspark.sources import adapters as given

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trades_are_shuffled_once_on_their_way_to_positions(spark):
    got = plan(positions.project(given.redelivered(given.trades(spark, SMALL), "version")))
    assert got.count("Exchange") == 1


def test_balances_from_a_snapshot_read_the_events_three_times_and_not_more(spark):
    got = plan(registry.QUERIES["balances_from_snapshot"](spark, SMALL))
    # the tail, the snapshot that begins it, and the snapshot that its balances are added to
    assert 1 <= got.count("orders.parquet") <= 3
    assert plan(ledger.balances(given.ledger_events(spark, SMALL))).count("Exchange") == 1


@pytest.mark.parametrize("size, parts", [(10, None), (400, None), (401, 5), (4000, 40)])
def test_partitions_follow_the_rows(spark, size, parts):
    rows = spark.range(50).withColumnRenamed("id", "k")
    out = dealt(rows, "k", size, part_rows=100)
    assert (out is rows) if parts is None else (out.rdd.getNumPartitions() == parts)
    assert sorted(r.k for r in out.collect()) == list(range(50))


def test_balances_after_several_opens_and_without_events(spark):
    schema = "stream_id long, version long, event_type string, pence long"
    rows = [(1, 1, "account:opened", 0), (1, 2, "money:deposited", 5), (1, 3, "account:opened", 0), (1, 4, "money:deposited", 7), (1, 5, "money:withdrawn", 2)]
    rows += [(2, 1, "money:deposited", 9), (3, 1, "account:opened", 0), (3, 2, "other", 4), (None, 1, "money:deposited", 3)]
    events = spark.createDataFrame(rows, schema).repartition(3)
    want = {(1, True, 5, 5, 5), (2, False, 9, 1, 1), (3, True, 0, 2, 2), (None, False, 3, 1, 1)}
    assert {tuple(r) for r in ledger.balances(events).collect()} == want
    for version, tails in ((1, {1: 4, 3: 1}), (2, {1: 3, 3: 0}), (4, {1: 1, 3: 0})):
        read = {1: tails[1], 2: 1, 3: tails[3], None: 1}
        got = {tuple(r) for r in ledger.current(events, ledger.snapshot(events, version)).collect()}
        assert got == {(s, e, b, v, read[s]) for s, e, b, v, _ in want}
    kept = spark.createDataFrame([(8, 6, 44)], "stream_id long, version long, balance long")
    assert (8, True, 44, 6, 0) in {tuple(r) for r in ledger.current(events, kept).collect()}


def test_shards_with_an_empty_book_a_failed_one_and_one_that_occurs_twice(spark):
    sharded = spark.createDataFrame([("a", "X"), ("a", "none"), ("b", "Y"), ("b", "X"), ("c", "lost"), ("d", None)], "shard string, book string")
    held = spark.createDataFrame([("X", "p", 2, 1), ("X", "Q", 3, 1), ("Y", "q", 4, 1), ("Y", None, 5, 1)], "book string, symbol string, net_quantity int, realized_cash int")
    held = held.selectExpr("book", "symbol", "cast(net_quantity as decimal(38,2)) net_quantity", "cast(realized_cash as decimal(38,4)) realized_cash")
    marks = spark.createDataFrame([("P", 10)], "symbol string, mid int").selectExpr("symbol", "cast(mid as decimal(18,2)) mid")
    lost = spark.createDataFrame([("lost",), ("lost",)], "book string")
    got = {r.shard: (float(r.market_value), float(r.realized_cash), r.valued, list(r.unpriced), r.failed) for r in risk.shard_partials(sharded, held, marks, lost).collect()}
    assert got == {"a": (20.0, 2.0, 1, ["Q"], False), "b": (20.0, 4.0, 1, ["Q"], False), "c": (0.0, 0.0, 0, [], True), "d": (0.0, 0.0, 0, [], False)}
