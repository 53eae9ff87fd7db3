"""Orders: stock allocation in order of arrival, outcomes with compensation, refunds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.column_fold import NOTHING, Arrays, Decision, column_fold
from foldspark.functions.expressions import first_failure, member_of


_GOT = ("ok", "conflict", "not-found")


def _reserve(state: Arrays, row: dict[str, np.ndarray]) -> tuple[Arrays, Arrays]:
    known, remaining = state
    ok = known & row["_asked?"] & (remaining >= row["_asked"])
    remaining = np.where(ok, remaining - row["_asked"], remaining)
    return (known, remaining), (np.where(ok, 0, np.where(known, 1, 2)), np.where(known, remaining, NOTHING))


def _reserve_one(state: tuple, row: dict) -> tuple[tuple, tuple]:
    known, remaining = state
    if not known:
        return state, (2, NOTHING)
    if not row["_asked?"] or remaining < row["_asked"]:
        return state, (1, remaining)
    return (known, remaining - row["_asked"]), (0, remaining - row["_asked"])


#: What a request gets of a SKU's stock. A null quantity is a conflict.
RESERVE = Decision(["_asked", "stock"], "got string, remaining bigint", {"got": _GOT}, lambda row: (row["stock?"], row["stock"].astype(np.int64)), _reserve, _reserve_one)


def _allocated(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """The requests with all their columns, `stock`, and of each whether it got stock (`got`) and what `remaining` is then."""
    table = stock.select(F.upper(F.col("sku").cast("string")).alias("_key"), F.col("stock"))
    rows = requests.withColumns({"_key": F.upper(F.col("sku").cast("string")), "_asked": F.col("quantity").cast("bigint")}).join(table, "_key", "left")
    return column_fold(rows, "_key", ["arrival"], RESERVE)


def allocate(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """Decide (sku, arrival, quantity) requests in order: status ok, conflict or not-found, and what remains.

    A conflict takes nothing, so a smaller request after it may still succeed. SKUs match ignoring case.
    """
    return _allocated(requests.select("sku", "arrival", "quantity"), stock).select("sku", "arrival", F.col("_asked").alias("quantity"), F.col("got").alias("status"), "remaining")


def place(requests: DataFrame, customers: DataFrame, stock: DataFrame) -> DataFrame:
    """Outcome of (sku, arrival, customer, quantity, unit_price) requests: (sku, arrival, status, amount, charged, refunded).

    Quantity above zero, then a known customer, then an amount above zero, then the charge, then the stock. A request that
    gets no stock has its charge refunded. Only charged requests compete for stock.
    """
    rows = member_of(requests, "customer", customers, "_known").withColumn("amount", (F.col("quantity") * F.col("unit_price")).cast("decimal(38,2)"))
    status, _ = first_failure(
        (F.coalesce(F.col("quantity") <= 0, F.lit(True)), "validation-error", "quantity"),
        (~F.col("_known"), "not-found", "customer"),
        (F.coalesce(F.col("amount") <= 0, F.lit(True)), "validation-error", "amount"),
    )
    checked = rows.withColumn("status", status)
    charged = checked.where("status = 'ok'")
    done = _allocated(charged.select("sku", "arrival", "quantity", "amount"), stock).select("sku", "arrival", F.col("got").alias("status"), "amount", F.lit(True).alias("charged"), (F.col("got") != "ok").alias("refunded"))
    refused = checked.where("status <> 'ok'").select("sku", "arrival", "status", "amount", F.lit(False).alias("charged"), F.lit(False).alias("refunded"))
    return done.unionByName(refused)


def refunds(requests: DataFrame, charges: DataFrame) -> DataFrame:
    """Add `refunded` to (charge_id, arrival) requests: true for the first one of an existing charge."""
    known = charges.select("charge_id").distinct().withColumn("_there", F.lit(True))
    first = F.row_number().over(Window.partitionBy("charge_id").orderBy("arrival")) == 1
    return requests.join(known, "charge_id", "left").withColumn("refunded", first & F.col("_there").isNotNull()).drop("_there")


def net_charged(charges: DataFrame, refunded: DataFrame, by: str) -> DataFrame:
    """(by, charges, amount) of the charges without a refund."""
    return charges.join(refunded, "charge_id", "left_anti").groupBy(by).agg(F.count("*").alias("charges"), F.sum("amount").cast("decimal(38,2)").alias("amount"))
