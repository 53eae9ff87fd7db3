"""Trade booking and position keeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.expressions import blank, first_failure

AMOUNT = "decimal(38,4)"


def with_flows(trades: DataFrame) -> DataFrame:
    """Add signed_quantity and cash: buying adds quantity and pays, selling the reverse; other sides are neither."""
    sign = F.when(F.col("side") == "Buy", 1).when(F.col("side") == "Sell", -1)
    return trades.withColumns({"signed_quantity": (F.col("quantity") * sign).cast("decimal(38,2)"), "cash": (-F.col("quantity") * F.col("price") * sign).cast(AMOUNT)})


def once(deliveries: DataFrame) -> DataFrame:
    """One row for each (book, version), however often it was delivered."""
    return deliveries.dropDuplicates(["book", "version"])


def project(deliveries: DataFrame) -> DataFrame:
    """(book, symbol, net_quantity, realized_cash) of at-least-once trades."""
    return with_flows(once(deliveries)).groupBy("book", "symbol").agg(F.sum("signed_quantity").cast("decimal(38,2)").alias("net_quantity"), F.sum("cash").cast(AMOUNT).alias("realized_cash"))


def watermark(deliveries: DataFrame) -> DataFrame:
    """(book, projected_through): the highest version seen of each book."""
    return deliveries.groupBy("book").agg(F.max("version").alias("projected_through"))


def for_books(books: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Positions of the requested books; an unknown book has one row without a symbol, at version 0."""
    rows = books.join(project(deliveries), "book", "left").join(watermark(deliveries), "book", "left")
    return rows.withColumn("projected_through", F.coalesce("projected_through", F.lit(0).cast("bigint")))


def validate(trades: DataFrame) -> DataFrame:
    """Add status and error of each trade; the first broken rule decides."""
    status, error = first_failure(
        (blank(F.col("book")), "validation-error", "book"),
        (blank(F.col("symbol")), "validation-error", "symbol"),
        (~F.coalesce(F.col("side").isin("Buy", "Sell"), F.lit(False)), "validation-error", "side"),
        (F.coalesce(F.col("quantity") <= 0, F.lit(True)), "validation-error", "quantity"),
        (F.coalesce(F.col("price") <= 0, F.lit(True)), "validation-error", "price"),
    )
    return trades.withColumns({"status": status, "error": error})


def book(trades: DataFrame, heads: DataFrame, order: list[str]) -> DataFrame:
    """Valid trades with their versions, counted on from (book, version) heads."""
    good = validate(trades).where("status = 'ok'").drop("status", "error")
    number = F.row_number().over(Window.partitionBy("book").orderBy(*order))
    head = heads.select("book", F.col("version").alias("_head"))
    return good.withColumn("_n", number).join(head, "book", "left").withColumn("version", (F.coalesce("_head", F.lit(0)) + F.col("_n")).cast("bigint")).drop("_n", "_head")
