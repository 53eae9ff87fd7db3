"""Run stores, intervals and incremental projections against rebuilds."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foldspark.functions import intervals
from foldspark.operators import bars, positions, views
from foldspark.sources import run_store
from foldspark.streaming import incremental

TICKS = "seq long, symbol string, price decimal(18,6), size long, bar string"


def ticks(rng, first, n):
    return [(first + k, f"S{rng.randint(0, 3)}", Decimal(rng.randint(1, 99)), rng.randint(1, 9), f"b{(first + k) // 40}") for k in range(n)]


def summed(rows):
    return rows.groupBy("k").agg(F.sum("v").alias("v"))


def test_fifty_batches_cost_what_they_hold(spark, tmp_path):
    rng, out, sent, written = random.Random(7), str(tmp_path / "bars"), [], []
    for version in range(50):
        batch = ticks(rng, 12 * version, 12) + rng.sample(sent, min(len(sent), 4))  # some come again, from any batch
        sent += batch[:12]
        written.append(incremental.apply(spark.createDataFrame(batch, TICKS), version, out, incremental.BARS))
        if version in (17, 49):  # a replay, and one after which later versions come again
            incremental.apply(spark.createDataFrame(batch, TICKS), version, out, incremental.BARS)
    live, again = incremental.read(spark, out, incremental.BARS), bars.ohlc(spark.createDataFrame(sent, TICKS))
    assert live.exceptAll(again.select(live.columns)).isEmpty() and live.count() == again.count()
    # 12 new rows a batch make at most as many states and intervals each, rewritten at most once a level
    assert sum(written) <= 50 * 12 * 2 * 3 and max(written[k] for k in range(50) if (k + 1) % 8) <= 24
    for table in incremental.stores(spark, out, incremental.BARS).values():
        assert len(table.runs()) <= 2 * run_store.FANOUT and len(table.versions()) <= run_store.KEPT_VERSIONS
        files = list((tmp_path / "bars").glob("*/runs/*"))
        assert len(files) <= 4 * 2 * run_store.FANOUT + 6


def test_positions_and_tenants_in_any_batches(spark, tmp_path):
    rng = random.Random(3)
    trades = [(f"B{k % 3}", 1 + k // 3, f"P{rng.randint(0, 4)}", rng.choice(["Buy", "Sell", "?"]), Decimal(rng.randint(1, 9)), Decimal(2)) for k in range(120)]
    schema = "book string, version long, symbol string, side string, quantity decimal(18,2), price decimal(18,2)"
    sent = [*trades, *rng.sample(trades, 30), (None, 1, "P0", "Buy", Decimal(1), Decimal(1))]
    rng.shuffle(sent)
    for version in range(9):
        incremental.apply(spark.createDataFrame(sent[version::9], schema), version, str(tmp_path / "p"), incremental.POSITIONS, fanout=3)
    live, want = incremental.read(spark, str(tmp_path / "p"), incremental.POSITIONS), positions.project(spark.createDataFrame(sent, schema))
    assert live.exceptAll(want).isEmpty() and live.count() == want.count()

    tenants = spark.createDataFrame([(k % 5, f"c{k}", 1 + k // 5, "tenant:renamed" if k > 4 else "tenant:created") for k in range(20)], "tenant_id long, company string, version long, topic string")
    users = spark.createDataFrame([(f"u{k}", k % 7, f"{k % 3}@x") for k in range(30)], "user_id string, tenant_id long, email string")
    logs = views.record(tenants, users)
    records = views.replay(*logs.items()).persist()
    for version in range(4):
        incremental.apply(records.where(F.pmod(F.hash("body"), F.lit(3)) == version % 3), version, str(tmp_path / "t"), incremental.TENANTS, fanout=2)
    assert views.diff(incremental.read(spark, str(tmp_path / "t"), incremental.TENANTS), views.rebuild(logs)).isEmpty()
    incremental.apply(records.where("topic = 'user:created'"), 0, str(tmp_path / "u"), incremental.TENANTS)
    assert {r.tenant_version for r in incremental.read(spark, str(tmp_path / "u"), incremental.TENANTS).collect()} == {0}
    assert incremental.read(spark, str(tmp_path / "none"), incremental.BARS) is None


def test_buckets_split_where_they_grow(spark, tmp_path):
    table = run_store.RunStore(spark, str(tmp_path / "t"), ["k"], summed, fanout=2, bucket_rows=100)
    for version in range(6):
        table.append(spark.range(40 * version, 40 * version + 400 * (version % 2) + 40).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")), version)
    sizes = [n for r in table.runs() for n in r["buckets"].values()]
    assert max(sizes) <= 100 and sum(sizes) == sum(r["rows"] for r in table.runs()) and len(sizes) < 40
    got = {r.k: r.v for r in table.read().collect()}
    want = {}
    for version in range(6):
        for k in range(40 * version, 40 * version + 400 * (version % 2) + 40):
            want[k] = want.get(k, 0) + 1
    assert got == want
    asked = spark.createDataFrame([(3,), (555,), (9999,)], "k long")
    some = table.candidates(asked, 5)
    assert sum(r.v for r in some.where("k = 3").collect()) == want[3] and some.count() < sum(sizes)
    # a skewed hash: one ending has most rows, and its bucket alone is split
    assert run_store.split_buckets({0: 900, 1: 10, 2: 10, 3: 10}, 2, 100) == {"2-0": 900, "2-2": 10, "1-1": 20}


def test_a_reader_sees_whole_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    table = run_store.RunStore(spark, path, ["k"], summed, fanout=2)
    rows = spark.createDataFrame([(1, 1)], "k long, v long")
    for version in range(5):
        table.append(rows, version)
    assert [r.v for r in table.read().collect()] == [5] and [r.v for r in table.read(3).collect()] == [4]
    early = table.read(4)  # planned before the next version is written
    table._write(rows, 0)  # a run that no version names, as after a failure
    assert [r.v for r in table.read().collect()] == [5]
    table.append(rows, 5)
    assert [r.v for r in early.collect()] == [5] and len(list((tmp_path / "t/runs").iterdir())) == len({r["folder"] for v in table.versions() for r in table.runs(v)})
    table.append(rows, 4)  # version 4 comes again: 5 is of a history that is over
    assert table.versions()[-1] == 4 and [r.v for r in table.read().collect()] == [5]


@pytest.mark.parametrize("cell", [4, 1 << 14])
def test_intervals(spark, monkeypatch, cell):
    monkeypatch.setattr(intervals, "CELL", cell)
    rng, held = random.Random(cell), None
    seen = set()
    for _ in range(4):
        some = [(rng.choice(["a", "b", None]), rng.choice([*range(-20, 20), None])) for _ in range(40)]
        rows = spark.createDataFrame(some, "k string, v long")
        fresh = intervals.unseen(rows, held, ["k"], "v").collect()
        assert sorted(map(repr, ((r.k, r.v) for r in fresh))) == sorted(map(repr, {s for s in some if s[1] is None or s not in seen}))
        seen |= {s for s in some if s[1] is not None}
        new = intervals.as_intervals(rows, ["k"], "v")
        held = spark.createDataFrame(intervals.merge_intervals(new if held is None else held.unionByName(new), ["k"]).collect(), new.schema)
        got = {(r.k, v) for r in intervals.members(held, ["k"], "all").collect() for v in r["all"]}
        assert got == seen
        assert all(r.hi // cell == r.lo // cell == r.cell for r in held.collect())
