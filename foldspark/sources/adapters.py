"""The operators' inputs, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspark.functions.ranges import RANGE_ROWS, dealt
from foldspark.sources.tables import read_table

MONEY = "decimal(18,2)"
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, symbol, price, size, bar): one tick an event, in bars of an hour."""
    size = F.get_json_object("props", "$.k").cast("bigint")
    return read_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.col("value").cast(MONEY).alias("price"), size.alias("size"), F.date_trunc("hour", "ts").cast("timestamp").alias("bar"))


def redelivered(rows: DataFrame, key: str, every: int = 7) -> DataFrame:
    """An at-least-once stream: every so-many-th row, by key, arrives twice."""
    times = F.when(F.col(key) % every == 0, 2).otherwise(1)
    return rows.withColumn("_delivery", F.explode(F.sequence(F.lit(1), times))).drop("_delivery")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, version, symbol, side, quantity, price): one trade a line item, versions ascending in each book."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    # dealt by the name of the book, so that what folds by book after it finds its rows together
    lines = read_table(spark, sf_dir, "lineitem")
    rows = dealt(lines.select(F.concat(F.lit("S"), "l_suppkey").alias("book"), *order), "book", lines.count(), RANGE_ROWS // 2)
    version = F.row_number().over(Window.partitionBy("book").orderBy(*order)).cast("bigint")
    return rows.select(
        "book", version.alias("version"), F.concat(F.lit("P"), "l_partkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy").alias("side"), F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("price")
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, mid): every tenth part has no mark."""
    return read_table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.col("p_retailprice").cast(MONEY).alias("mid"))


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, version, event_type, payload, pence): every 50th customer never opens an account."""
    opened = read_table(spark, sf_dir, "customer").where("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("stream_id"), F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("k"), F.lit("account:opened").alias("event_type"), F.lit(0).cast("bigint").alias("pence"))
    kind = F.when(F.col("o_orderstatus") == "F", "money:deposited").when(F.col("o_orderstatus") == "P", "money:deposited:v1").otherwise("money:withdrawn")
    moved = read_table(spark, sf_dir, "orders").select(F.col("o_custkey"), F.lit(1), F.col("o_orderkey"), kind, F.round(F.col("o_totalprice") * 100).cast("bigint"))
    version = F.row_number().over(Window.partitionBy("stream_id").orderBy("ord", "k")).cast("bigint")
    payload = F.when(F.col("event_type") == "account:opened", F.to_json(F.struct(F.col("stream_id").cast("string").alias("account_id"), F.lit("GBP").alias("currency")))).when(
        F.col("event_type") == "money:deposited:v1", F.to_json(F.struct("pence", F.concat(F.lit("ref-"), "k").alias("reference")))
    ).otherwise(F.to_json(F.struct("pence", F.lit("GBP").alias("currency"), F.concat(F.lit("ref-"), "k").alias("reference"))))
    rows = dealt(opened.union(moved), "stream_id", read_table(spark, sf_dir, "orders").count())
    return rows.select("stream_id", version.alias("version"), "event_type", payload.alias("payload"), "pence")


def tenant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant_id, company, version, topic): every tenth tenant has no create event."""
    created = read_table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("company"), F.lit(1).cast("bigint").alias("version"), F.lit("tenant:created").alias("topic"))
    version = F.lit(1) + F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    renamed = read_table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", F.concat(F.lit("co-"), "o_orderkey"), version.cast("bigint"), F.lit("tenant:renamed"))
    return created.union(renamed)


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, tenant_id, email)."""
    user = F.concat(F.lit("u"), "event_id")
    return read_table(spark, sf_dir, "events").where("event_type = 'signup'").select(user.alias("user_id"), F.col("user_id").alias("tenant_id"), F.concat(user, F.lit("@x.io")).alias("email"))


def cdc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, new_image): change records, some of them no inserts or with totals that are no numbers."""
    total = F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast(MONEY).cast("string"))
    image = F.create_map(F.lit("order_id"), F.concat(F.lit("ord-"), "o_orderkey"), F.lit("customer"), F.concat(F.lit("c"), "o_custkey"), F.lit("total"), total)
    return read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 11 == 0, "MODIFY").otherwise("INSERT").alias("op"), image.alias("new_image"))


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sku, arrival, customer, quantity, unit_price): one request a line item; arrival ascends in each sku."""
    arrival = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*[c for c in _LINE if c != "l_partkey"])).cast("bigint")
    quantity = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_quantity").cast("int"))
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), arrival.alias("arrival"), F.concat(F.lit("c"), F.col("l_orderkey") % 97).alias("customer"), quantity.alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("unit_price"))


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sku, stock): every 25th sku is unknown."""
    return read_table(spark, sf_dir, "part").where("p_partkey % 25 <> 0").select(F.col("p_partkey").alias("sku"), (F.col("p_size") * 15).cast("bigint").alias("stock"))


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(saga_id, company, plan, email): blank companies, unknown plans, bad addresses and sticky companies all occur."""
    company = F.when(F.col("c_custkey") % 17 == 0, "").when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("sticky-"), "c_name")).otherwise(F.col("c_name"))
    plan = F.when(F.col("c_mktsegment") == "FURNITURE", "platinum").when(F.col("c_mktsegment") == "BUILDING", "Enterprise").otherwise("standard")
    email = F.when(F.col("c_custkey") % 7 == 0, "not-an-email").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit("@x.io")))
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("saga_id"), company.alias("company"), plan.alias("plan"), email.alias("email"))


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, session_id, symbol, unwatch): a click watches, an error stops watching."""
    return read_table(spark, sf_dir, "events").where("event_type in ('click', 'error')").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"), F.when(F.col("value") > 100, "purchase").otherwise("view").alias("symbol"), (F.col("event_type") == "error").alias("unwatch"))
