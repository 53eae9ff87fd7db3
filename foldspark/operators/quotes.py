"""Quotes: enrichment with greeks, subscriptions, gaps, snapshots and watch lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.expressions import normal_cdf, normal_pdf
from foldspark.functions.ranges import RANGE_ROWS, with_ranges

HALF_SPREAD, VOLATILITY, RATE, TENOR_YEARS = 0.0002, 0.25, 0.04, 30 / 365
#: Ticks in a range of the watch list's join, and its ranges at most.
CELL_TICKS, MOST_CELLS = 1 << 10, 1 << 16


def enrich(marks: DataFrame, volatility: Column | float = VOLATILITY, rate: Column | float = RATE, tenor: Column | float = TENOR_YEARS) -> DataFrame:
    """Add bid, ask and the greeks of an at-the-money call on `mid`: vega a point of volatility, theta a day.

    With strike and spot equal, d1 = (rate + vol^2 / 2) * sqrt(tenor) / vol. All are rounded to six places, half away from
    zero. The parameters may be columns.
    """
    vol, r, t = (x if isinstance(x, Column) else F.lit(x) for x in (volatility, rate, tenor))
    spot = F.col("mid").cast("double")
    d1 = (r + vol * vol / 2) * F.sqrt(t) / vol
    d2 = d1 - vol * F.sqrt(t)
    theta = -spot * normal_pdf(d1) * vol / (2 * F.sqrt(t)) - r * spot * F.exp(-r * t) * normal_cdf(d2)
    greeks = {"delta": normal_cdf(d1), "gamma": normal_pdf(d1) / (spot * vol * F.sqrt(t)), "vega": spot * normal_pdf(d1) * F.sqrt(t) / 100, "theta": theta / 365}
    return marks.withColumns({"bid": F.round(spot * (1 - HALF_SPREAD), 6), "ask": F.round(spot * (1 + HALF_SPREAD), 6)} | {k: F.round(v, 6) for k, v in greeks.items()})


def known(quotes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Quotes of known symbols, in the reference table's spelling; symbols match ignoring case."""
    table = symbols.select(F.upper("symbol").alias("_key"), F.col("symbol").alias("_name")).dropDuplicates(["_key"])
    return quotes.withColumn("_key", F.upper("symbol")).join(table, "_key").withColumn("symbol", F.col("_name")).drop("_key", "_name")


def subscribe(ticks: DataFrame, symbols: DataFrame, max_ticks: int = 0) -> DataFrame:
    """The first max_ticks ticks by seq of each known symbol; 0 is all."""
    rows = known(ticks, symbols)
    if max_ticks <= 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy("seq"))).where(F.col("_n") <= max_ticks).drop("_n")


def gaps(ticks: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(symbol, after_seq, before_seq, missing): holes in each symbol's sequence.

    Holes are found inside ranges of seq, and between the last tick of a symbol in one range and its first in the next, so
    no task sorts all ticks of a symbol.
    """
    rows = with_ranges(ticks.select("symbol", "seq").where("seq is not null"), "seq", range_rows)
    inside = rows.select("symbol", F.lag("seq").over(Window.partitionBy("symbol", "_range").orderBy("seq")).alias("after_seq"), F.col("seq").alias("before_seq"))
    ends = rows.groupBy("symbol", "_range").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    between = ends.select("symbol", F.lag("last").over(Window.partitionBy("symbol").orderBy("_range")).alias("after_seq"), F.col("first").alias("before_seq"))
    return inside.unionByName(between).where("before_seq - after_seq > 1").withColumn("missing", F.col("before_seq") - F.col("after_seq") - 1)


def snapshot(requests: DataFrame, ticks: DataFrame) -> DataFrame:
    """The latest tick of each requested symbol, with status ok or not-found."""
    latest = ticks.groupBy(F.upper("symbol").alias("_key")).agg(F.max("seq").alias("seq"), F.max_by("price", "seq").alias("price"))
    out = requests.withColumn("_key", F.upper("symbol")).join(latest, "_key", "left").drop("_key")
    return out.withColumn("status", F.when(F.col("seq").isNull(), "not-found").otherwise("ok"))


def intervals(watches: DataFrame) -> DataFrame:
    """(session_id, key, start, end) of (session_id, symbol, seq, unwatch) requests; an open end is null.

    Watching twice, or ending what isn't watched, does nothing. key is the symbol in upper case.
    """
    keyed = watches.withColumn("key", F.upper("symbol"))
    turn = Window.partitionBy("session_id", "key").orderBy("seq")
    changes = keyed.withColumn("_was", F.lag("unwatch", 1, True).over(turn)).where("unwatch <> _was")
    return changes.withColumn("end", F.lead("seq").over(turn)).where("not unwatch").select("session_id", "key", F.col("seq").alias("start"), "end")


def watchlist(ticks: DataFrame, watches: DataFrame, width: int | None = None) -> DataFrame:
    """(session_id, symbol, start, seq, kind): what each watch delivers.

    kind `snapshot` is the latest tick at or before the watch, kind `tick` every later one before its end. Both are found on
    (symbol, range of seq): ticks by a join with the intervals, each repeated for the ranges that it touches, snapshots by
    the latest tick of the range so far, or else of the nearest range before it. So no task orders all ticks of a symbol.
    `width` is the span of seq in a range; by default it holds CELL_TICKS ticks on average, or more where the ticks' whole
    span would have more than MOST_CELLS ranges, so an open watch is repeated once for about a thousand ticks.
    """
    low, high, n = ticks.agg(F.min("seq"), F.max("seq"), F.count("seq")).first()
    if n == 0:
        low, high = 0, 0
    if width is None:
        width = -(-(high - low + 1) // min(MOST_CELLS, -(-max(n, 1) // CELL_TICKS)))
    spans = intervals(watches)
    cell, top = lambda seq: F.floor(F.col(seq) / width), high // width
    rows = ticks.select(F.upper("symbol").alias("key"), "symbol", "seq", cell("seq").alias("cell"))
    reach = spans.withColumn("cell", F.explode(F.sequence(cell("start"), F.greatest(cell("start"), F.least(F.coalesce(cell("end"), F.lit(top)), F.lit(top))))))
    live = reach.join(rows, ["key", "cell"]).where("seq > start and (end is null or seq < end)").select("session_id", "symbol", "start", "seq", F.lit("tick").alias("kind"))

    tick = F.struct("seq", "symbol")
    asked = spans.select("session_id", "key", cell("start").alias("cell"), F.col("start").alias("at"), F.lit(None).cast(ticks.schema["symbol"].dataType).alias("symbol"), F.lit(1).alias("ask"))
    both = rows.select(F.lit(None).cast(spans.schema["session_id"].dataType).alias("session_id"), "key", "cell", F.col("seq").alias("at"), "symbol", F.lit(0).alias("ask")).unionByName(asked)
    so_far = Window.partitionBy("key", "cell").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last(F.when(F.col("ask") == 0, F.struct(F.col("at").alias("seq"), "symbol")), ignorenulls=True).over(so_far)
    starts = both.withColumn("near", near).where("ask = 1").drop("symbol", "ask")
    # the latest tick of the nearest earlier range, for each range that a start is in
    tops = rows.groupBy("key", "cell").agg(F.max(tick).alias("top")).unionByName(asked.select("key", "cell", F.lit(None).cast(rows.select(tick).schema[0].dataType).alias("top")).distinct())
    earlier = Window.partitionBy("key").orderBy("cell").rangeBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("before", F.max("top").over(earlier)).groupBy("key", "cell").agg(F.max("before").alias("before"))
    shown = starts.join(carried, ["key", "cell"]).withColumn("tick", F.coalesce("near", "before")).where("tick is not null")
    return live.unionByName(shown.select("session_id", "tick.symbol", F.col("at").alias("start"), "tick.seq", F.lit("snapshot").alias("kind")))


def watch_counts(ticks: DataFrame, watches: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(session_id, symbol, start, kind, ticks, first_seq, last_seq): how much each watch delivers, and from where to where.

    The same as counting `watchlist`, but no tick is listed for a watch: ticks and the watches' bounds are put in one order, and
    running counts at the two bounds are subtracted. The order is made in cells of `width` seq for each symbol, and cells are
    added up afterwards, so no task orders all ticks of a symbol, and ticks are read once. Where ticks of one symbol are spelled
    in several ways, `symbol` is the last one's spelling.
    """
    cell = F.floor(F.col("at") / width).alias("cell")
    spans = intervals(watches).select("session_id", "key", "start", "end")
    bounds = spans.select("session_id", "key", "start", F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(2).alias("turn")), F.struct(F.col("end").alias("at"), F.lit(0).alias("turn"))))).where("at is not null")
    none, kind = F.lit(None), ticks.schema["symbol"].dataType
    listed = ticks.where("seq is not null").select(none.cast(spans.schema["session_id"].dataType).alias("session_id"), F.upper("symbol").alias("key"), none.cast(spans.schema["start"].dataType).alias("start"), F.col("seq").alias("at"), F.lit(1).alias("turn"), "symbol")
    rows = listed.unionByName(bounds.withColumn("symbol", none.cast(kind))).select("*", cell)

    # inside a cell; a bound's turn says on which side of a tick of the same seq it is
    inside = Window.partitionBy("key", "cell")
    up, down = inside.orderBy("at", "turn"), inside.orderBy(F.desc("at"), F.desc("turn"))
    tick = F.when(F.col("turn") == 1, F.struct(F.col("at").alias("seq"), "symbol"))
    swept = rows.select(
        "session_id", "key", "start", "turn", "cell",
        F.count(tick).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
        F.last(tick, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("last"),
        F.last(tick, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))["seq"].alias("next"),
        F.when(F.row_number().over(up) == 1, F.struct(F.count(tick).over(inside).alias("n"), F.max(tick).over(inside).alias("last"), F.min(tick).over(inside)["seq"].alias("first"))).alias("all"),
    ).where("turn <> 1 or all is not null")

    # what the cells before and after one hold
    whole = Window.partitionBy("key")
    before, after = (whole.orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (F.col("cell"), F.desc("cell")))
    placed = swept.select(
        "session_id", "key", "start", "turn",
        (F.col("n") + F.coalesce(F.sum("all.n").over(before), F.lit(0))).alias("n"),
        F.coalesce("last", F.max("all.last").over(before)).alias("last"),
        F.coalesce("next", F.min("all.first").over(after)).alias("next"),
        F.sum("all.n").over(whole).alias("total"),
        F.max("all.last").over(whole).alias("newest"),
    ).where("turn <> 1")
    begun, ended = F.col("turn") == 2, F.col("turn") == 0
    each = placed.groupBy("session_id", "key", "start").agg(
        F.max(F.when(begun, F.col("n"))).alias("n"), F.max(F.when(begun, F.col("last"))).alias("shown"), F.max(F.when(begun, F.col("next"))).alias("first"),
        F.coalesce(F.max(F.when(ended, F.col("n"))), F.max("total")).alias("upto"), F.when(F.count_if(ended) > 0, F.max(F.when(ended, F.col("last")))).otherwise(F.max("newest")).alias("last"),
    )
    live, shown = F.col("upto") - F.col("n"), F.col("shown")
    out = F.array(
        F.when(live > 0, F.struct(F.col("last.symbol").alias("symbol"), F.lit("tick").alias("kind"), live.alias("ticks"), F.col("first").alias("first_seq"), F.col("last.seq").alias("last_seq"))),
        F.when(shown.isNotNull(), F.struct(shown["symbol"].alias("symbol"), F.lit("snapshot").alias("kind"), F.lit(1).cast("long").alias("ticks"), shown["seq"].alias("first_seq"), shown["seq"].alias("last_seq"))),
    )
    return each.select("session_id", "start", F.inline(F.array_compact(out))).select("session_id", "symbol", "start", "kind", "ticks", "first_seq", "last_seq")
