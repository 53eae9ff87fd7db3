"""Folds by columns against folds row by row."""

import random

import numpy as np
import pytest

from foldspark.functions import column_fold
from foldspark.functions.column_fold import NOTHING, fold_rows
from foldspark.functions.ordered_fold import ordered_fold
from foldspark.operators import ledger, orders


def commands(rng, n):
    return {
        "kind": rng.integers(-1, 3, n).astype(np.int8), "kind?": np.ones(n, bool), "pence": rng.integers(-2, 40, n), "pence?": rng.random(n) < 0.9,
        "expected_version": rng.integers(-1, 5, n), "expected_version?": rng.random(n) < 0.4, "invalid": rng.random(n) < 0.1, "invalid?": np.ones(n, bool),
        "exists": rng.random(n) < 0.5, "exists?": np.ones(n, bool), "balance": rng.integers(0, 90, n), "balance?": np.ones(n, bool), "head": rng.integers(0, 3, n), "head?": np.ones(n, bool),
    }


def requests(rng, n):
    return {"_asked": rng.integers(-1, 9, n), "_asked?": rng.random(n) < 0.9, "stock": rng.integers(0, 60, n), "stock?": rng.random(n) < 0.9}


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("decision", "draw"), [(ledger.COMMANDS, commands), (orders.RESERVE, requests)])
def test_columns_and_rows_decide_alike(seed, decision, draw):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    begins = np.unique(np.r_[0, rng.integers(0, n, rng.integers(0, 40))])
    columns = draw(rng, n)
    whole, end = fold_rows(begins, columns, decision, None, few=0)
    for few in (3, 10**6):  # at the latter only the first row of each key is decided by columns
        again, same = fold_rows(begins, columns, decision, None, few)
        assert end == same and all((a == b).all() for a, b in zip(whole, again, strict=True))
    cut = int(rng.integers(1, n + 1))  # a batch ends inside a key
    left, state = fold_rows(begins[begins < cut], {c: v[:cut] for c, v in columns.items()}, decision, None)
    if cut < n:
        goes_on = cut not in begins
        right, last = fold_rows(np.unique(np.r_[0, begins[begins >= cut] - cut]), {c: v[cut:] for c, v in columns.items()}, decision, state if goes_on else None)
        assert last == end and all((np.r_[a, b] == w).all() for a, b, w in zip(left, right, whole, strict=True))


def test_small_batches_and_hot_keys(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", f"s{rng.randint(0, 90)}", None]), k, rng.choice([None, 0, 1, 2, 5, 9]), k % 7) for k in range(3000)]
    asked = spark.createDataFrame(rows, "sku string, arrival long, quantity int, stock int")
    stock = spark.createDataFrame([("HOT", 400), *((f"S{k}", k) for k in range(80))], "sku string, stock long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted(map(repr, orders.allocate(asked, stock).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = {"HOT": 400} | {f"S{k}": k for k in range(80)}
    want = []
    for sku, k, q, _ in rows:
        key = sku and sku.upper()
        if key not in left:
            want.append((sku, k, q, "not-found", None))
            continue
        ok = q is not None and left[key] >= q
        left[key] -= q if ok else 0
        want.append((sku, k, q, "ok" if ok else "conflict", left[key]))
    assert len(got) == len(want) and got == sorted(repr(r) for r in orders.allocate(asked, stock).collect())
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in orders.allocate(asked, stock).collect())


def test_a_fold_of_any_state(spark):
    """The general form, a step in Python for each row."""
    rows = spark.createDataFrame([(k % 3, k, k * k) for k in range(30)], "key long, at long, v long")

    def step(state, row):
        state = (state or 0) + row[0]
        return state, (state, "odd" if state % 2 else None)

    got = {(r.key, r.at): (r.total, r.kind) for r in ordered_fold(rows, "key", ["at"], step, "total bigint, kind string", ["v"]).collect()}
    for k in range(30):
        total = sum(j * j for j in range(k % 3, k + 1, 3))
        assert got[k % 3, k] == (total, "odd" if total % 2 else None)
    assert NOTHING == np.iinfo(np.int64).min and column_fold.FEW_KEYS > 0
