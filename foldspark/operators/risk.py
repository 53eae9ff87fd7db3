"""Mark-to-market, sharded risk runs and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.expressions import blank
from foldspark.functions.ranges import RANGE_ROWS, with_row_number
from foldspark.operators.positions import AMOUNT, project


def normalized_books(requests: DataFrame, by: str = "request_id") -> DataFrame:
    """(by, pos, book): blanks dropped, trimmed, distinct ignoring case; the first spelling and its place stay."""
    rows = requests.where(~blank(F.col("book"))).withColumn("book", F.trim("book"))
    first = F.row_number().over(Window.partitionBy(by, F.upper("book")).orderBy("pos"))
    return rows.withColumn("_n", first).where("_n = 1").select(by, "pos", "book")


def mark(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """Add mid, market_value and priced to positions; symbols match ignoring case. No mark is unpriced, never zero."""
    table = marks.select(F.upper("symbol").alias("_key"), F.col("mid"))
    value = (F.col("net_quantity") * F.col("mid")).cast(AMOUNT)
    return positions.withColumn("_key", F.upper("symbol")).join(table, "_key", "left").drop("_key").withColumns({"market_value": value, "priced": F.col("mid").isNotNull()})


def unpriced(positions: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct symbols without a mark, ignoring case, in the spelling that sorts first."""
    known = marks.select(F.upper("symbol").alias("_key")).distinct()
    return positions.where("symbol is not null").withColumn("_key", F.upper("symbol")).join(known, "_key", "left_anti").groupBy("_key").agg(F.min("symbol").alias("symbol")).drop("_key")


def shard_books(books: DataFrame, size: int, by: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add `shard` (shard-0, shard-1, ...) to (pos, book) rows in order of pos; a size below 1 is 1."""
    numbered = with_row_number(books, "_place", ["pos"], by=by, range_rows=range_rows)
    return numbered.withColumn("shard", F.concat(F.lit("shard-"), F.floor((F.col("_place") - 1) / max(1, size)).cast("string"))).drop("_place")


def _names(key: str, name: str) -> Column:
    """The names that aren't null, one for each key, sorted by key; the keys must be distinct."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(key).alias("k"), F.col(name).alias("s")))))
    return F.transform(pairs, lambda p: p["s"])


def shard_partials(sharded: DataFrame, positions: DataFrame, marks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row a shard: market value of the priced, cash of all positions, positions valued, unpriced symbols, failed.

    A book in `failed` could not be read, which fails its whole shard; an unknown book is merely empty.
    """
    unread = (failed if failed is not None else sharded.limit(0)).select("book", F.lit(True).alias("_failed"))
    books = sharded.select("shard", "book")
    # positions come by book, and the few books of each partition are looked up where they are; only the marks need a shuffle
    held = positions.join(books.hint("shuffle_hash"), "book").select("shard", "symbol", "net_quantity", "realized_cash")
    some = F.col("symbol").isNotNull()
    rows = mark(held, marks).select("shard", F.when(some & ~F.col("priced"), F.col("symbol")).alias("_name"), "market_value", "realized_cash", (some & F.col("priced")).alias("_valued"), F.lit(None).cast("boolean").alias("_failed"))
    # a row a book beside them, for books without positions and those that could not be read
    flags = books.join(unread.distinct(), "book", "left").select("shard", "_failed")
    # priced rows fold into one row a shard where they are; only unpriced symbols go on by name
    spelled = rows.unionByName(flags, allowMissingColumns=True).groupBy("shard", "_name").agg(
        F.sum("market_value").alias("market_value"),
        F.sum("realized_cash").alias("realized_cash"),
        F.count(F.when(F.col("_valued"), 1)).alias("valued"),
        F.max("_failed").alias("failed"),
    )
    keyed = spelled.groupBy("shard", F.upper("_name").alias("_key")).agg(
        *(F.sum(c).alias(c) for c in ("market_value", "realized_cash", "valued")),
        F.max("failed").alias("failed"),
        F.min("_name").alias("name"),
    )
    return keyed.groupBy("shard").agg(
        F.coalesce(F.sum("market_value"), F.lit(0)).cast(AMOUNT).alias("market_value"),
        F.coalesce(F.sum("realized_cash"), F.lit(0)).cast(AMOUNT).alias("realized_cash"),
        F.sum("valued").alias("valued"),
        _names("_key", "name").alias("unpriced"),
        F.coalesce(F.max("failed"), F.lit(False)).alias("failed"),
    )


def run(sharded: DataFrame, deliveries: DataFrame, marks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The firm's row: sums of the shards that succeeded, and apart from them how much of the firm they cover.

    unpriced and failed name the symbols without a mark and the shards that failed, sorted; a run's row grows with these
    names only. unpriced_symbols and failed_shards are their numbers.
    """
    parts = shard_partials(sharded, project(deliveries), marks, failed)
    # one row a shard and unpriced symbol, so that one pass gives the sums and the distinct symbols
    rows = parts.select("*", F.posexplode_outer("unpriced").alias("place", "symbol"))
    shard, fine = F.coalesce("place", F.lit(0)) == 0, ~F.col("failed")
    keyed = rows.groupBy(F.upper("symbol").alias("_key")).agg(
        *(F.sum(F.when(shard & fine, F.col(c))).alias(c) for c in ("market_value", "realized_cash", "valued")),
        F.count(F.when(shard, 1)).alias("shards"),
        F.count(F.when(shard & ~fine, 1)).alias("failed_shards"),
        F.collect_list(F.when(shard & ~fine, F.col("shard"))).alias("failed_names"),
        F.min(F.when(fine, F.col("symbol"))).alias("name"),
    )
    total = keyed.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).cast(AMOUNT).alias(c) for c in ("market_value", "realized_cash")),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("valued", "shards", "failed_shards")),
        F.array_sort(F.flatten(F.collect_list("failed_names"))).alias("failed"),
        _names("_key", "name").alias("unpriced"),
    )
    total = total.withColumn("unpriced_symbols", F.size("unpriced").cast("long"))
    return total.withColumns({"total": (F.col("market_value") + F.col("realized_cash")).cast(AMOUNT), "is_complete": F.col("failed_shards") == 0, "is_fully_priced": F.col("unpriced_symbols") == 0})
