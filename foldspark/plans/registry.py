"""Name -> query and name -> reference SQL of the event-log operators.

The SQL is written for DuckDB over the same tables. Each text names the input views that it needs; their definitions, the
SQL forms of `foldspark.sources.adapters`, go in front of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions.expressions import iso_utc, mint_id
from foldspark.operators import bars, ledger, logs, orders, outbox, positions, quotes, reactions, risk, saga, views
from foldspark.sources import adapters as given
from foldspark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

INPUTS = {
    "ticks": """SELECT event_id AS seq, event_type AS symbol, CAST(value AS DECIMAL(18,2)) AS price, CAST(json_extract_string(props, '$.k')
    AS BIGINT) AS size, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bar FROM events""",
    "tick_deliveries": "SELECT * FROM ticks UNION ALL SELECT * FROM ticks WHERE seq % 7 = 0",
    "trades": """SELECT concat('S', l_suppkey) AS book, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS version,
        concat('P', l_partkey) AS symbol, CASE WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS side, CAST(l_quantity AS DECIMAL(18,2))
    AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem""",
    "flows": """SELECT *, CASE side WHEN 'Buy' THEN quantity ELSE -quantity END AS signed_quantity, CAST(CASE side WHEN 'Buy' THEN -quantity * price ELSE quantity * price
    END AS DECIMAL(38,4)) AS cash FROM trades""",
    "position": "SELECT book, symbol, CAST(sum(signed_quantity) AS DECIMAL(38,2)) AS net_quantity, CAST(sum(cash) AS DECIMAL(38,4)) AS realized_cash FROM flows GROUP BY book, symbol",
    "marks": "SELECT concat('P', p_partkey) AS symbol, CAST(p_retailprice AS DECIMAL(18,2)) AS mid FROM part WHERE p_partkey % 10 <> 0",
    "ledger": """SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY ord, k) AS version, event_type, pence, k FROM (
        SELECT c_custkey AS stream_id, 0 AS ord, CAST(0 AS BIGINT) AS k, 'account:opened' AS event_type, CAST(0 AS BIGINT) AS pence FROM customer WHERE c_custkey
    % 50 <> 0
        UNION ALL SELECT o_custkey, 1, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'money:deposited' WHEN 'P' THEN 'money:deposited:v1' ELSE 'money:withdrawn'
    END, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders)""",
    "changes": "SELECT *, CAST(CASE WHEN event_type LIKE 'money:deposited%' THEN pence WHEN event_type = 'money:withdrawn' THEN -pence ELSE 0 END AS BIGINT) AS change FROM ledger",
    "balance": "SELECT stream_id, bool_or(event_type = 'account:opened') AS \"exists\", CAST(sum(change) AS BIGINT) AS balance, max(version) AS version, count(*) AS events_read FROM changes GROUP BY stream_id",
    "tenant_event": """SELECT c_custkey AS tenant_id, c_name AS company, CAST(1 AS BIGINT) AS version, 'tenant:created' AS topic FROM customer WHERE c_custkey % 10 <> 0
        UNION ALL SELECT o_custkey, concat('co-', o_orderkey), 1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey),
    'tenant:renamed' FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "user_event": "SELECT concat('u', event_id) AS user_id, user_id AS tenant_id, concat('u', event_id, '@x.io') AS email FROM events WHERE event_type = 'signup'",
    "latest": "SELECT tenant_id, arg_max(company, version) AS company, max(version) AS tenant_version FROM tenant_event GROUP BY tenant_id",
    "cdc": """SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'MODIFY' ELSE 'INSERT' END AS op, concat('ord-', o_orderkey)
    AS order_id, concat('c', o_custkey) AS customer,
        CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS total FROM orders""",
    "request": """SELECT l_partkey AS sku, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS arrival,
        concat('c', l_orderkey % 97) AS customer, CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price FROM lineitem""",
    "stocks": "SELECT p_partkey AS sku, CAST(p_size * 15 AS BIGINT) AS stock FROM part WHERE p_partkey % 25 <> 0",
    "signup": """SELECT c_custkey AS saga_id, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN concat('sticky-', c_name) ELSE c_name END AS company,
        CASE c_mktsegment WHEN 'FURNITURE' THEN 'platinum' WHEN 'BUILDING' THEN 'Enterprise' ELSE 'standard' END AS plan,
    CASE WHEN c_custkey % 7 = 0 THEN 'not-an-email' ELSE concat(c_custkey, '@x.io') END AS email FROM customer""",
    "outcome": """SELECT saga_id, company, trim(company) <> '' AS t, plan <> 'platinum' AS b, email LIKE '%@%' AS u, company LIKE 'sticky%' AS sticky FROM signup""",
    "reaction_event": """SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 9 = 0 THEN concat('bounce-', c_name) ELSE c_name END AS company, CASE c_mktsegment WHEN 'BUILDING'
    THEN 'enterprise' ELSE 'standard' END AS plan,
        concat('corr-', c_custkey) AS correlation_id, c_custkey AS seq, concat(c_custkey, '@x.io') AS email, concat('evt-', c_custkey) AS event_id FROM customer""",
    "watch": """SELECT event_id AS seq, user_id AS session_id, CASE WHEN value > 100 THEN 'purchase' ELSE 'view' END AS symbol, event_type = 'error' AS unwatch FROM events
    WHERE event_type IN ('click', 'error')""",
}


def query(name: str, sql: str | None = None, inputs: str = "") -> Callable[[Query], Query]:
    """Register a query; `inputs` names the input views of its SQL, in order."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            views_ = ", ".join(f"{v} AS ({INPUTS[v]})" for v in inputs.split())
            recursive = sql.lstrip().startswith("RECURSIVE ")
            body = sql.lstrip().removeprefix("RECURSIVE ")
            own = not body.startswith("SELECT")  # the text begins with common table expressions of its own
            head = f"WITH {'RECURSIVE ' * recursive}{views_}{', ' * bool(own and views_)}" if own or views_ else ""
            ORACLES[name] = f"{head} {body}".strip()
        return run

    return add


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, book): all books, and one that nobody knows."""
    known = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("S"), "s_suppkey").alias("book"))
    unknown = read_table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("pos")).withColumn("book", F.lit("NOBODY"))
    return known.union(unknown)


_BOOKS = "SELECT s_suppkey AS pos, concat('S', s_suppkey) AS book FROM supplier UNION ALL SELECT max(s_suppkey) + 1, 'NOBODY' FROM supplier"
_SHARDED = f"""sharded AS (SELECT pos, book, CAST((row_number() OVER (ORDER BY pos) - 1) // 4 AS BIGINT) AS n, concat('shard-', CAST((row_number()
    OVER (ORDER BY pos) - 1) // 4 AS BIGINT)) AS shard FROM ({_BOOKS}))"""
_PARTIALS = (
    _SHARDED
    + """, unread AS (SELECT DISTINCT shard FROM sharded WHERE book LIKE 'S%' AND CAST(substr(book, 2) AS BIGINT) % 37 = 0),
    valued AS (SELECT s.shard, p.symbol, m.mid, p.realized_cash, CAST(p.net_quantity * m.mid AS DECIMAL(38,4)) AS mv FROM sharded s LEFT JOIN position p USING
    (book) LEFT JOIN marks m ON upper(p.symbol) = upper(m.symbol)),
    partials AS (SELECT shard, CAST(coalesce(sum(mv), 0) AS DECIMAL(38,4)) AS market_value, CAST(coalesce(sum(realized_cash), 0) AS DECIMAL(38,4)) AS realized_cash,
        count(mid) AS valued, coalesce(string_agg(DISTINCT upper(symbol), ',' ORDER BY upper(symbol)) FILTER (symbol IS NOT NULL AND mid IS NULL),
    '') AS unpriced, shard IN (SELECT shard FROM unread) AS failed FROM valued GROUP BY shard)"""
)


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.shard_books(_books(spark, sf_dir), 4)


def _unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that could not be read in this run."""
    return read_table(spark, sf_dir, "supplier").where("s_suppkey % 37 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("book"))


def _reaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("bounce-"), "c_name")).otherwise(F.col("c_name"))
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "enterprise").otherwise("standard")
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"), company.alias("company"), plan.alias("plan"), F.concat(F.lit("corr-"), "c_custkey").alias("correlation_id"), F.col("c_custkey").alias("seq"), F.concat(F.col("c_custkey"), F.lit("@x.io")).alias("email"), F.concat(F.lit("evt-"), "c_custkey").alias("event_id"))


# ---------------------------------------------------------------- logs and bars


@query("log_read_batch", "SELECT seq, symbol, price, size FROM ticks WHERE seq > 500 ORDER BY seq LIMIT 100", "ticks")
def log_read_batch(spark, sf_dir):
    return logs.read_after(given.ticks(spark, sf_dir), 500).select("seq", "symbol", "price", "size")


@query("log_publish_summary", """SELECT symbol, count(*) AS records, min(n) AS first_seq, max(n) AS last_seq FROM (SELECT symbol, 1000000 + row_number()
    OVER (ORDER BY seq) AS n FROM ticks) GROUP BY symbol""", "ticks")
def log_publish_summary(spark, sf_dir):
    rows = given.ticks(spark, sf_dir).withColumnRenamed("seq", "arrival")
    return logs.append_summary(logs.assign_sequence(rows, 1_000_000, ["arrival"]), ["symbol"])


@query("redelivered_events", "SELECT symbol, count(*) AS records, CAST(sum(greatest(1, least(10, size % 15))) AS BIGINT) AS deliveries FROM ticks GROUP BY symbol", "ticks")
def redelivered_events(spark, sf_dir):
    rows = given.ticks(spark, sf_dir).withColumn("times", F.col("size") % 15)
    return logs.redeliver(rows, "times").groupBy("symbol").agg(F.count_distinct("seq").alias("records"), F.count("*").alias("deliveries"))


@query("count_windows", """SELECT symbol, n // 3 AS window_no, count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT symbol,
    seq, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS n FROM ticks) GROUP BY ALL""", "ticks")
def count_windows(spark, sf_dir):
    return logs.count_windows(given.ticks(spark, sf_dir), 3, "symbol")


@query("log_status", """SELECT symbol, count(*) AS records, max(seq) AS last_seq, coalesce(max(seq) FILTER (bar < TIMESTAMP '2024-01-20'), 0) AS checkpoint,
    max(seq) - coalesce(max(seq) FILTER (bar < TIMESTAMP '2024-01-20'), 0) AS lag FROM ticks GROUP BY symbol""", "ticks")
def log_status(spark, sf_dir):
    rows = given.ticks(spark, sf_dir)
    done = rows.where("bar < timestamp'2024-01-20'").groupBy("symbol").agg(F.max("seq").alias("checkpoint"))
    return logs.status(rows, done, "symbol")


_OHLC = """SELECT symbol, bar, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(size)
    AS BIGINT) AS volume, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS sequences FROM"""


def _flat_bars(frame: DataFrame) -> DataFrame:
    return frame.withColumn("sequences", F.array_join(F.col("sequences").cast("array<string>"), ","))


@query("ohlc_bars", f"{_OHLC} ticks GROUP BY symbol, bar", "ticks")
def ohlc_bars(spark, sf_dir):
    return _flat_bars(bars.ohlc(given.redelivered(given.ticks(spark, sf_dir), "seq")))


@query("ohlc_bars_naive", f"{_OHLC} tick_deliveries GROUP BY symbol, bar", "ticks tick_deliveries")
def ohlc_bars_naive(spark, sf_dir):
    return _flat_bars(bars.ohlc(given.redelivered(given.ticks(spark, sf_dir), "seq"), dedupe=False))


@query("ohlc_inflation", """SELECT symbol, bar, CAST(sum(size) AS BIGINT) AS volume, CAST(sum(CASE WHEN seq % 7 = 0 THEN 2 * size ELSE size END) AS BIGINT)
    AS naive_volume FROM ticks GROUP BY symbol, bar HAVING sum(size) <> sum(CASE WHEN seq % 7 = 0 THEN 2 * size ELSE size END)""", "ticks")
def ohlc_inflation(spark, sf_dir):
    return bars.inflation(given.redelivered(given.ticks(spark, sf_dir), "seq"))


@query(
    "ohlc_rebuild_diff",
    """SELECT symbol, bar, CAST(sum(size) AS BIGINT) AS volume, 'live' AS side FROM ticks WHERE seq % 400 <> 0 GROUP BY symbol,
    bar EXCEPT SELECT symbol, bar, CAST(sum(size) AS BIGINT), 'live' FROM ticks GROUP BY symbol, bar"""
    """ UNION ALL (SELECT symbol, bar, CAST(sum(size) AS BIGINT), 'rebuilt' FROM ticks GROUP BY symbol, bar EXCEPT SELECT symbol,
    bar, CAST(sum(size) AS BIGINT), 'rebuilt' FROM ticks WHERE seq % 400 <> 0 GROUP BY symbol, bar)""",
    "ticks",
)
def ohlc_rebuild_diff(spark, sf_dir):
    """Live bars that missed some ticks, against the bars rebuilt from the log, by volume."""
    ticks = given.ticks(spark, sf_dir)
    live = bars.ohlc(ticks.where("seq % 400 <> 0")).select("symbol", "bar", "volume")
    return bars.rebuild_diff(live, given.redelivered(ticks, "seq"))


# ---------------------------------------------------------------- ledger


@query("ledger_read_tail", "SELECT stream_id, version, event_type, pence FROM ledger WHERE version > 5", "ledger")
def ledger_read_tail(spark, sf_dir):
    return ledger.read(given.ledger_events(spark, sf_dir), from_version=5).select("stream_id", "version", "event_type", "pence")


@query(
    "decode_ledger_events",
    """SELECT stream_id, version, event_type, true AS known, CASE WHEN event_type = 'account:opened' THEN CAST(stream_id AS VARCHAR)
    END AS account_id, CAST(NULL AS VARCHAR) AS holder,
    CASE WHEN event_type <> 'money:deposited:v1' THEN 'GBP' END AS currency, CASE WHEN event_type <> 'account:opened' THEN pence END AS pence,
    CASE WHEN event_type <> 'account:opened' THEN concat('ref-', k) END AS reference FROM ledger""",
    "ledger",
)
def decode_ledger_events(spark, sf_dir):
    return ledger.decode(given.ledger_events(spark, sf_dir))


@query(
    "upcast_deposits",
    """SELECT stream_id, version, CASE event_type WHEN 'money:deposited:v1' THEN 'money:deposited' ELSE event_type END AS event_type, 'GBP' AS currency, CASE WHEN event_type <> 'account:opened' THEN pence END AS pence FROM ledger""",
    "ledger",
)
def upcast_deposits(spark, sf_dir):
    return ledger.decode(ledger.upcast(given.ledger_events(spark, sf_dir))).select("stream_id", "version", "event_type", "currency", "pence")


@query(
    "ledger_history",
    """SELECT stream_id, version, event_type, CASE event_type WHEN 'account:opened' THEN concat('{"account_id":"', stream_id, '","currency":"GBP"}')
    WHEN 'money:deposited:v1' THEN concat('{"pence":', pence, ',"reference":"ref-', k, '"}')
    ELSE concat('{"pence":', pence, ',"currency":"GBP","reference":"ref-', k, '"}') END AS payload, count(*) OVER (PARTITION BY stream_id) AS events FROM ledger""",
    "ledger",
)
def ledger_history(spark, sf_dir):
    return ledger.history(given.ledger_events(spark, sf_dir))


@query("account_balances", 'SELECT stream_id, "exists", balance, version, events_read FROM balance', "ledger changes balance")
def account_balances(spark, sf_dir):
    return ledger.balances(given.ledger_events(spark, sf_dir))


@query("balances_as_of", "SELECT stream_id, bool_or(event_type = 'account:opened') AS \"exists\", CAST(sum(change) AS BIGINT) AS balance, max(version) AS version, count(*) AS events_read FROM changes WHERE version <= 4 GROUP BY stream_id", "ledger changes")
def balances_as_of(spark, sf_dir):
    return ledger.as_of(given.ledger_events(spark, sf_dir), 4)


@query("balance_history", "SELECT stream_id, version, CAST(sum(change) OVER (PARTITION BY stream_id ORDER BY version) AS BIGINT) AS balance FROM changes", "ledger changes")
def balance_history(spark, sf_dir):
    return ledger.balance_history(given.ledger_events(spark, sf_dir))


@query(
    "balances_from_snapshot",
    """SELECT b.stream_id, "exists", balance, version, (SELECT count(*) FROM ledger l WHERE l.stream_id = b.stream_id AND (l.version > 5 OR NOT b."exists")) AS events_read FROM balance b""",
    "ledger changes balance",
)
def balances_from_snapshot(spark, sf_dir):
    events = given.ledger_events(spark, sf_dir)
    return ledger.current(events, ledger.snapshot(events, 5))


@query("snapshot_equivalence", 'SELECT "exists", count(*) AS accounts, CAST(0 AS BIGINT) AS different FROM balance GROUP BY "exists"', "ledger changes balance")
def snapshot_equivalence(spark, sf_dir):
    """Accounts whose balance depends on whether a snapshot was used: none may."""
    events = given.ledger_events(spark, sf_dir)
    fast = ledger.current(events, ledger.snapshot(events, 3)).select("stream_id", F.col("balance").alias("b"), F.col("version").alias("v"), F.col("exists").alias("e"))
    both = ledger.balances(events).join(fast, "stream_id", "full_outer")
    odd = ~(F.col("balance").eqNullSafe(F.col("b")) & F.col("version").eqNullSafe(F.col("v")) & F.col("exists").eqNullSafe(F.col("e")))
    return both.groupBy("exists").agg(F.count("*").alias("accounts"), F.count(F.when(odd, 1)).alias("different"))


@query("assigned_versions", """SELECT e.user_id AS stream_id, event_id, coalesce(b.version, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id)
    AS version FROM events e LEFT JOIN balance b ON b.stream_id = e.user_id""", "ledger changes balance")
def assigned_versions(spark, sf_dir):
    new = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "event_id")
    return ledger.assign_versions(new, ledger.balances(given.ledger_events(spark, sf_dir)), ["event_id"])


@query(
    "command_results",
    """RECURSIVE command AS (SELECT user_id AS account_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id AS arrival,
        CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'withdraw' ELSE 'deposit' END AS kind, CAST(round(value * 10000)
    AS BIGINT) * CASE WHEN event_id % 31 = 0 THEN 0 ELSE 1 END AS pence,
        CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS expected_version FROM events),
    start AS (SELECT c.account_id, coalesce(b."exists", false) AS e, coalesce(b.balance, 0) AS bal, coalesce(b.version, 0) AS head FROM (SELECT DISTINCT account_id
    FROM command) c LEFT JOIN balance b ON b.stream_id = c.account_id),
    fold AS (
        SELECT account_id, CAST(0 AS BIGINT) AS n, e, CAST(bal AS BIGINT) AS bal, CAST(head AS BIGINT) AS head, '' AS status FROM start
        UNION ALL
        SELECT account_id, n, e OR (status = 'ok' AND kind = 'open'), CAST(CASE WHEN status <> 'ok' THEN bal WHEN kind = 'open' THEN 0 WHEN kind = 'deposit'
    THEN bal + pence ELSE bal - pence END AS BIGINT), CAST(head + CASE WHEN status = 'ok' THEN 1 ELSE 0 END AS BIGINT), status
        FROM (SELECT f.account_id, c.n, f.e, f.bal, f.head, c.kind, c.pence, CASE
            WHEN kind = 'open' AND f.head > 0 THEN 'conflict' WHEN kind = 'open' THEN 'ok' WHEN pence <= 0 THEN 'validation-error' WHEN NOT f.e THEN 'not-found'
            WHEN kind = 'withdraw' AND f.bal < pence THEN 'validation-error' WHEN expected_version > 0 AND expected_version <> f.head THEN 'conflict' ELSE
    'ok' END AS status
            FROM fold f JOIN command c ON c.account_id = f.account_id AND c.n = f.n + 1))
    SELECT c.account_id, c.arrival, c.kind, c.pence, f.status, f.bal AS new_balance, f.head AS new_version FROM fold f JOIN command c USING (account_id, n)""",
    "ledger changes balance",
)
def command_results(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "withdraw").otherwise("deposit")
    pence = F.when(F.col("event_id") % 31 == 0, 0).otherwise(F.round(F.col("value") * 10000)).cast("bigint")
    commands = events.select(F.col("user_id").alias("account_id"), F.col("event_id").alias("arrival"), kind.alias("kind"), pence.alias("pence"), F.when(F.col("event_id") % 19 == 0, 1).otherwise(0).cast("bigint").alias("expected_version"), F.lit("someone").alias("holder"))
    return ledger.adjudicate(commands, given.ledger_events(spark, sf_dir)).select("account_id", "arrival", "kind", "pence", "status", "new_balance", "new_version")


# ---------------------------------------------------------------- positions and risk


@query("trade_flows", "SELECT book, version, signed_quantity, cash FROM flows", "trades flows")
def trade_flows(spark, sf_dir):
    return positions.with_flows(given.trades(spark, sf_dir)).select("book", "version", "signed_quantity", "cash")


@query("positions", "SELECT * FROM position", "trades flows position")
def positions_(spark, sf_dir):
    return positions.project(given.redelivered(given.trades(spark, sf_dir), "version"))


@query("projected_through", "SELECT book, max(version) AS projected_through FROM trades GROUP BY book", "trades")
def projected_through(spark, sf_dir):
    return positions.watermark(given.redelivered(given.trades(spark, sf_dir), "version"))


@query("book_positions", f"""SELECT b.book, p.symbol, p.net_quantity, p.realized_cash, coalesce(w.v, 0) AS projected_through FROM ({_BOOKS}) b LEFT JOIN position p USING (book)
    LEFT JOIN (SELECT book, max(version) AS v FROM trades GROUP BY book) w USING (book)""", "trades flows position")
def book_positions(spark, sf_dir):
    return positions.for_books(_books(spark, sf_dir).select("book"), given.trades(spark, sf_dir))


_RAW = """raw AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN ' ' ELSE concat('S', l_suppkey) END AS book, CASE l_returnflag WHEN 'R' THEN 'Sell' WHEN
    'A' THEN 'Buy' ELSE 'Hold' END AS side, CAST(l_quantity AS DECIMAL(18,2)) - 10 AS quantity, CAST(l_extendedprice AS DECIMAL(18,2))
    AS price FROM lineitem)"""


def _raw_trades(spark, sf_dir):
    line = read_table(spark, sf_dir, "lineitem")
    book = F.when(F.col("l_linenumber") == 1, " ").otherwise(F.concat(F.lit("S"), "l_suppkey"))
    side = F.when(F.col("l_returnflag") == "R", "Sell").when(F.col("l_returnflag") == "A", "Buy").otherwise("Hold")
    return line.select(F.col("l_orderkey").alias("id"), book.alias("book"), F.concat(F.lit("P"), "l_partkey").alias("symbol"), side.alias("side"), (F.col("l_quantity").cast("decimal(18,2)") - 10).alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))


@query("validated_trades", f"""{_RAW} SELECT status, error, count(*) AS trades FROM (SELECT CASE WHEN trim(book) = '' THEN 'book' WHEN side = 'Hold' THEN 'side' WHEN quantity <= 0 THEN
    'quantity' WHEN price <= 0 THEN 'price' END AS error, CASE WHEN error IS NULL THEN 'ok' ELSE 'validation-error' END AS status FROM raw)
    GROUP BY status, error""")
def validated_trades(spark, sf_dir):
    return positions.validate(_raw_trades(spark, sf_dir)).groupBy("status", "error").agg(F.count("*").alias("trades"))


@query(
    "booked_trades",
    "heads AS (SELECT book, max(version) AS head FROM trades GROUP BY book), " + _RAW + """ SELECT r.book, count(*) AS trades, max(h.head) + 1 AS first_version, max(h.head) + count(*) AS last_version FROM raw r JOIN heads h USING (book)
    WHERE trim(r.book) <> '' AND side <> 'Hold' AND quantity > 0 AND price > 0 GROUP BY r.book""",
    "trades",
)
def booked_trades(spark, sf_dir):
    heads = positions.watermark(given.trades(spark, sf_dir)).withColumnRenamed("projected_through", "version")
    booked = positions.book(_raw_trades(spark, sf_dir), heads, ["id", "symbol", "quantity", "price"])
    return booked.groupBy("book").agg(F.count("*").alias("trades"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


@query(
    "normalized_books",
    """rows AS (SELECT l_orderkey AS request_id, l_linenumber * 100000 + l_suppkey AS pos, CASE WHEN l_linenumber = 2 THEN '  ' WHEN l_linenumber % 2 = 1 THEN
    concat(' s', l_suppkey % 5) ELSE concat('S', l_suppkey % 5, ' ') END AS book FROM lineitem), """
    """first AS (SELECT request_id, upper(trim(book)) AS k, min(pos) AS pos FROM rows WHERE trim(book) <> '' GROUP BY ALL) SELECT DISTINCT f.request_id,
    f.pos, trim(r.book) AS book FROM first f JOIN rows r ON r.request_id = f.request_id AND r.pos = f.pos AND upper(trim(r.book))
    = f.k""",
)
def normalized_books(spark, sf_dir):
    digit = (F.col("l_suppkey") % 5).cast("string")
    text = F.when(F.col("l_linenumber") == 2, "  ").when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit(" s"), digit)).otherwise(F.concat(F.lit("S"), digit, F.lit(" ")))
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("pos"), text.alias("book"))
    return risk.normalized_books(rows)


@query("marked_positions", """SELECT p.book, p.symbol, m.mid, CAST(p.net_quantity * m.mid AS DECIMAL(38,4)) AS market_value, m.mid IS NOT NULL AS priced FROM position p LEFT JOIN marks
    m ON upper(p.symbol) = upper(m.symbol)""", "trades flows position marks")
def marked_positions(spark, sf_dir):
    return risk.mark(positions.project(given.trades(spark, sf_dir)), given.marks(spark, sf_dir)).select("book", "symbol", "mid", "market_value", "priced")


@query("unpriced_symbols", "SELECT DISTINCT symbol FROM trades WHERE upper(symbol) NOT IN (SELECT upper(symbol) FROM marks)", "trades marks")
def unpriced_symbols(spark, sf_dir):
    return risk.unpriced(positions.project(given.trades(spark, sf_dir)), given.marks(spark, sf_dir))


@query("risk_shard_assignment", f"{_SHARDED} SELECT pos, book, shard FROM sharded")
def risk_shard_assignment(spark, sf_dir):
    return _sharded(spark, sf_dir)


@query("risk_shards", f"{_PARTIALS} SELECT * FROM partials", "trades flows position marks")
def risk_shards(spark, sf_dir):
    parts = risk.shard_partials(_sharded(spark, sf_dir), positions.project(given.redelivered(given.trades(spark, sf_dir), "version")), given.marks(spark, sf_dir), _unread(spark, sf_dir))
    return parts.withColumn("unpriced", F.array_join("unpriced", ","))


@query(
    "risk_run",
    _PARTIALS
    + """ SELECT CAST(coalesce(sum(market_value) FILTER (NOT failed), 0) AS DECIMAL(38,4)) AS market_value, CAST(coalesce(sum(realized_cash)
    FILTER (NOT failed), 0) AS DECIMAL(38,4)) AS realized_cash, CAST(coalesce(sum(valued) FILTER (NOT failed), 0) AS BIGINT)
    AS valued,
    count(*) AS shards, count(*) FILTER (failed) AS failed_shards, (SELECT count(DISTINCT v.symbol) FROM valued v WHERE v.symbol IS NOT NULL AND v.mid IS
    NULL AND v.shard NOT IN (SELECT shard FROM unread)) AS unpriced_symbols,
    CAST(coalesce(sum(market_value) FILTER (NOT failed), 0) + coalesce(sum(realized_cash) FILTER (NOT failed), 0) AS DECIMAL(38,4))
    AS total, count(*) FILTER (failed) = 0 AS is_complete, (SELECT count(*) FROM valued v WHERE v.symbol IS NOT NULL AND v.mid IS NULL AND v.shard NOT IN
    (SELECT shard FROM unread)) = 0 AS is_fully_priced,
    coalesce(string_agg(shard, ',' ORDER BY shard) FILTER (failed), '') AS failed, coalesce((SELECT string_agg(s, ',' ORDER BY s)
    FROM (SELECT DISTINCT v.symbol AS s FROM valued v WHERE v.symbol IS NOT NULL AND v.mid IS NULL AND v.shard NOT IN (SELECT shard FROM unread))),
    '') AS unpriced FROM partials""",
    "trades flows position marks",
)
def risk_run(spark, sf_dir):
    row = risk.run(_sharded(spark, sf_dir), given.redelivered(given.trades(spark, sf_dir), "version"), given.marks(spark, sf_dir), _unread(spark, sf_dir))
    return row.withColumns({c: F.array_join(c, ",") for c in ("failed", "unpriced")})


# ---------------------------------------------------------------- read models


@query("tenant_latest", "SELECT * FROM latest", "tenant_event latest")
def tenant_latest(spark, sf_dir):
    return views.latest_by_version(given.tenant_events(spark, sf_dir))


@query("tenant_user_counts", "SELECT tenant_id, count(DISTINCT user_id) AS user_count FROM user_event GROUP BY tenant_id", "user_event")
def tenant_user_counts(spark, sf_dir):
    users = given.user_events(spark, sf_dir)
    return views.users_by_tenant(users.unionAll(users.where("tenant_id % 7 = 0"))).select("tenant_id", "user_count")


@query(
    "tenant_users_view",
    """members AS (SELECT tenant_id, count(*) AS n, string_agg(concat(user_id, ' ', email), ',' ORDER BY user_id) AS users FROM user_event GROUP BY tenant_id)
    SELECT coalesce(l.tenant_id, m.tenant_id) AS tenant_id, coalesce(company, '') AS company, coalesce(tenant_version, 0) AS tenant_version,
    coalesce(n, 0) AS user_count, coalesce(users, '') AS users FROM latest l FULL JOIN members m ON l.tenant_id = m.tenant_id""",
    "tenant_event latest user_event",
)
def tenant_users_view(spark, sf_dir):
    view = views.tenant_users(given.tenant_events(spark, sf_dir), given.user_events(spark, sf_dir))
    return view.withColumn("users", F.array_join(F.transform("users", lambda u: F.concat(u["user_id"], F.lit(" "), u["email"])), ","))


@query("recorded_log_read", """SELECT 'tenants' AS source, topic, count(*) AS events, min(tenant_id * 1000 + version) AS first_sequence, max(tenant_id * 1000 + version)
    AS last_sequence FROM tenant_event GROUP BY topic UNION ALL SELECT 'users', 'user:created', count(*), min(CAST(substr(user_id,
    2) AS BIGINT)), max(CAST(substr(user_id, 2) AS BIGINT)) FROM user_event""", "tenant_event user_event")
def recorded_log_read(spark, sf_dir):
    recorded = logs.read_recorded(views.record(given.tenant_events(spark, sf_dir), given.user_events(spark, sf_dir)))
    return recorded.groupBy("source", "topic").agg(F.count("*").alias("events"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


@query("replayed_log_counts", "SELECT 'tenants' AS source, count(*) AS events FROM tenant_event UNION ALL SELECT 'users', count(*) FROM user_event", "tenant_event user_event")
def replayed_log_counts(spark, sf_dir):
    return views.replay(*views.record(given.tenant_events(spark, sf_dir), given.user_events(spark, sf_dir)).items()).groupBy("source").agg(F.count("*").alias("events"))


@query("rebuild_diff", """SELECT tenant_id, 'left' AS side FROM user_event WHERE tenant_id % 11 = 0 GROUP BY tenant_id UNION ALL SELECT tenant_id,
    'right' FROM user_event WHERE tenant_id % 11 = 0 GROUP BY tenant_id""", "user_event")
def rebuild_diff(spark, sf_dir):
    """A live view that lost some users, against the view rebuilt in reverse from the logs."""
    tenants, users = given.tenant_events(spark, sf_dir), given.user_events(spark, sf_dir)
    live = views.tenant_users(tenants, users.withColumn("email", F.when(F.col("tenant_id") % 11 == 0, "old@x.io").otherwise(F.col("email"))))
    return views.diff(live, views.rebuild(views.record(tenants, users), reverse=True)).select("tenant_id", "side")


@query("view_lookup", """SELECT c_custkey AS tenant_id, l.company, l.tenant_version, CASE WHEN l.tenant_id IS NULL THEN 'not-found' ELSE 'ok' END AS status FROM customer LEFT
    JOIN latest l ON l.tenant_id = c_custkey""", "tenant_event latest")
def view_lookup(spark, sf_dir):
    requests = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return views.lookup(requests, views.latest_by_version(given.tenant_events(spark, sf_dir)), ["tenant_id"])


@query(
    "view_lag",
    """behind AS (SELECT tenant_id, max(version) AS v FROM tenant_event WHERE tenant_id % 6 <> 0 OR version < 3 GROUP BY tenant_id)
    SELECT l.tenant_id, l.tenant_version AS authority_version, coalesce(b.v, 0) AS view_version, l.tenant_version - coalesce(b.v,
    0) AS lag FROM latest l LEFT JOIN behind b USING (tenant_id)""",
    "tenant_event latest",
)
def view_lag(spark, sf_dir):
    events = given.tenant_events(spark, sf_dir)
    authority = views.latest_by_version(events).withColumnRenamed("tenant_version", "version")
    return views.lag(authority, views.latest_by_version(events.where("tenant_id % 6 <> 0 or version < 3")))


@query(
    "tenant_command_results",
    """command AS (SELECT o_custkey AS tenant_id, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'create' ELSE 'rename' END AS kind,
    CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE concat('new-', o_orderkey) END AS company FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey)
    FROM orders GROUP BY o_custkey)),
    decided AS (SELECT c.*, l.tenant_version AS head, CASE WHEN trim(c.company) = '' THEN 'validation-error' WHEN kind = 'rename' AND l.tenant_version IS
    NULL THEN 'not-found' WHEN kind = 'create' AND l.tenant_version IS NOT NULL THEN 'conflict' ELSE 'ok' END AS status FROM command c LEFT JOIN latest l
    USING (tenant_id))
    SELECT tenant_id, kind, company, status, CASE WHEN status = 'ok' THEN coalesce(head, 0) + 1 END AS new_version FROM decided""",
    "tenant_event latest",
)
def tenant_command_results(spark, sf_dir):
    """The last order of each customer alone as a command; `tenant_command_log` decides all of them."""
    return _decided(spark, sf_dir, read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))).drop("arrival")


def _decided(spark: SparkSession, sf_dir: str, orders_: DataFrame) -> DataFrame:
    """Orders as commands to the tenants of their customers, decided."""
    id_ = F.col("o_orderkey")
    commands = orders_.select(F.col("o_custkey").alias("tenant_id"), id_.alias("arrival"), F.when(id_ % 3 == 0, "create").otherwise("rename").alias("kind"), F.when(id_ % 17 == 0, " ").otherwise(F.concat(F.lit("new-"), id_)).alias("company"))
    heads = views.latest_by_version(given.tenant_events(spark, sf_dir)).withColumnRenamed("tenant_version", "version")
    return views.tenant_commands(commands, heads).select("tenant_id", "arrival", "kind", "company", "status", "new_version")


@query(
    "tenant_command_log",
    """RECURSIVE queue AS (SELECT o_custkey AS tenant_id, o_orderkey AS arrival, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
    AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'create' ELSE 'rename' END AS kind, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE concat('new-',
    o_orderkey) END AS company FROM orders),
    fold AS (SELECT q.tenant_id, CAST(0 AS BIGINT) AS n, CAST(max(l.tenant_version) AS BIGINT) AS head, '' AS status FROM queue q LEFT JOIN latest l USING
    (tenant_id) GROUP BY q.tenant_id
        UNION ALL SELECT q.tenant_id, q.n, CASE WHEN trim(q.company) <> '' AND (q.kind = 'rename') = (f.head IS NOT NULL) THEN coalesce(f.head, 0) + 1 ELSE f.head END,
            CASE WHEN trim(q.company) = '' THEN 'validation-error' WHEN q.kind = 'rename' AND f.head IS NULL THEN 'not-found' WHEN q.kind = 'create' AND f.head
    IS NOT NULL THEN 'conflict' ELSE 'ok' END FROM fold f JOIN queue q ON q.tenant_id = f.tenant_id AND q.n = f.n + 1)
    SELECT tenant_id, arrival, kind, company, status, CASE WHEN status = 'ok' THEN head END AS new_version FROM queue JOIN fold USING (tenant_id, n)""",
    "tenant_event latest",
)
def tenant_command_log(spark, sf_dir):
    return _decided(spark, sf_dir, read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"))


# ---------------------------------------------------------------- outbox and reactions

_GOOD = "op = 'INSERT' AND TRY_CAST(total AS DECIMAL(18,2)) IS NOT NULL"


@query("cdc_inserts", f"SELECT seq, order_id, customer, CAST(total AS DECIMAL(18,2)) AS total FROM cdc WHERE {_GOOD}", "cdc")
def cdc_inserts(spark, sf_dir):
    return outbox.inserts(given.cdc_orders(spark, sf_dir))


@query("cdc_skipped", f"SELECT seq, CASE WHEN op <> 'INSERT' THEN 'not an insert' ELSE 'bad total' END AS reason FROM cdc WHERE NOT ({_GOOD})", "cdc")
def cdc_skipped(spark, sf_dir):
    return outbox.skipped(given.cdc_orders(spark, sf_dir))


@query("order_created_events", f"SELECT CAST(seq AS VARCHAR) AS event_id, order_id, customer, CAST(total AS DECIMAL(18,2)) AS total FROM cdc WHERE {_GOOD}", "cdc")
def order_created_events(spark, sf_dir):
    return outbox.to_order_created(given.cdc_orders(spark, sf_dir))


@query("notification_stats", f"""SELECT customer, CAST(sum(CASE WHEN seq % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS deliveries, count(*) AS events, CAST(sum(CASE WHEN seq % 7 = 0 THEN 1
    ELSE 0 END) AS BIGINT) AS duplicates FROM cdc WHERE {_GOOD} GROUP BY customer""", "cdc")
def notification_stats(spark, sf_dir):
    events = outbox.to_order_created(given.redelivered(given.cdc_orders(spark, sf_dir), "seq"))
    return outbox.delivery_stats(events, "customer")


@query("outbox_gap", f"""SELECT order_id, 'order_without_event' AS kind FROM cdc WHERE op = 'INSERT' AND NOT ({_GOOD} AND seq % 23 <> 0) UNION ALL SELECT concat('ghost-',
    seq), 'event_without_order' FROM cdc WHERE seq % 29 = 0""", "cdc")
def outbox_gap(spark, sf_dir):
    """Some inserts have lost their event, and some changes published one for an order that was never committed."""
    changes = given.cdc_orders(spark, sf_dir)
    orders_ = changes.where("op = 'INSERT'").select(F.col("new_image")["order_id"].alias("order_id"))
    ghosts = changes.where("seq % 29 = 0").select(F.concat(F.lit("ghost-"), "seq").alias("order_id"))
    return outbox.reconcile(orders_, outbox.inserts(changes).where("seq % 23 <> 0").select("order_id").union(ghosts))


_JOURNAL = """entries AS (SELECT 'analytics' AS reaction, concat('signup: ', company, ' on ', plan) AS what, correlation_id, 'ok' AS status FROM reaction_event
    UNION ALL SELECT 'cache-warmer', concat('warmed ', tenant_id), correlation_id, 'ok' FROM reaction_event
    UNION ALL SELECT 'trial-clock', concat('trial started for ', tenant_id, ' (14 days)'), correlation_id, 'ok' FROM reaction_event WHERE plan = 'standard'
    UNION ALL SELECT 'welcome-email', concat(CASE WHEN company LIKE 'bounce%' THEN 'FAILED to email ' ELSE 'welcomed ' END,
    email), correlation_id, CASE WHEN company LIKE 'bounce%' THEN 'FAILED' ELSE 'ok' END FROM reaction_event)"""


@query("reaction_journal", f"{_JOURNAL} SELECT * FROM entries", "reaction_event")
def reaction_journal(spark, sf_dir):
    return reactions.journal(_reaction_events(spark, sf_dir))


@query("correlation_coverage", """SELECT r.reaction, count(*) AS emitted, count(*) FILTER (r.reaction <> 'trial-clock' OR plan = 'standard') AS found, count(*)
    FILTER (r.reaction = 'trial-clock' AND plan <> 'standard') AS missing FROM reaction_event CROSS JOIN (VALUES ('analytics'),
    ('cache-warmer'), ('trial-clock'), ('welcome-email')) r(reaction) GROUP BY r.reaction""", "reaction_event")
def correlation_coverage(spark, sf_dir):
    events = _reaction_events(spark, sf_dir)
    return reactions.trace(events, reactions.journal(events), list(reactions.REGISTRY))


@query(
    "correlation_missing",
    """SELECT r.reaction, correlation_id FROM reaction_event CROSS JOIN (VALUES ('analytics'), ('cache-warmer'), ('trial-clock'), ('welcome-email')) r(reaction)
    WHERE r.reaction = 'trial-clock' AND plan <> 'standard'""",
    "reaction_event",
)
def correlation_missing(spark, sf_dir):
    events = _reaction_events(spark, sf_dir)
    return reactions.missing(events, reactions.journal(events), list(reactions.REGISTRY))


@query(
    "retry_dead_letter",
    """shared AS (SELECT event_id, company, CASE WHEN seq % 8 <> 0 THEN concat('corr-', seq // 2) END AS correlation_id FROM reaction_event)
    SELECT event_id, correlation_id, 1 AS attempt, CASE WHEN company LIKE 'bounce%' THEN 'retry' ELSE 'done' END AS outcome FROM shared UNION ALL SELECT
    event_id, correlation_id, 2, 'dead-letter' FROM shared WHERE company LIKE 'bounce%'""",
    "reaction_event",
)
def retry_dead_letter(spark, sf_dir):
    """Correlation ids are shared by two events, or missing."""
    shared = F.when(F.col("seq") % 8 != 0, F.concat(F.lit("corr-"), F.expr("seq div 2")))
    events = _reaction_events(spark, sf_dir).withColumn("correlation_id", shared)
    return reactions.with_retries(events, reactions.welcome_email).select("event_id", "correlation_id", "attempt", "outcome")


@query("late_subscriber", "SELECT tenant_id, company, seq FROM reaction_event WHERE seq > 1000", "reaction_event")
def late_subscriber(spark, sf_dir):
    return reactions.subscribe(_reaction_events(spark, sf_dir), 1000).select("tenant_id", "company", "seq")


@query("deduped_events", """SELECT concat('topic-', event_type) AS topic, concat(user_id, ':', size) AS body, min(event_id) AS delivery FROM (SELECT *,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events) WHERE value >= 5 GROUP BY ALL""")
def deduped_events(spark, sf_dir):
    """Deliveries of a small value failed, so they hold no claim."""
    events = read_table(spark, sf_dir, "events")
    rows = events.select(F.concat(F.lit("topic-"), "event_type").alias("topic"), F.concat(F.col("user_id").cast("string"), F.lit(":"), F.get_json_object("props", "$.k")).alias("body"), F.col("event_id").alias("delivery"), F.when(F.col("value") < 5, "FAILED").otherwise("ok").alias("status"))
    return reactions.dedupe(rows).select("topic", "body", "delivery")


# ---------------------------------------------------------------- orders and sagas

_ALLOCATE = """queue AS (SELECT r.sku, r.arrival, r.quantity, row_number() OVER (PARTITION BY r.sku ORDER BY r.arrival) AS n, s.stock FROM chosen r LEFT JOIN stocks
    s USING (sku)),
    fold AS (SELECT sku, CAST(0 AS BIGINT) AS n, max(stock) AS remaining, '' AS status FROM queue GROUP BY sku
        UNION ALL SELECT q.sku, q.n, CASE WHEN f.remaining >= q.quantity THEN f.remaining - q.quantity ELSE f.remaining END,
    CASE WHEN f.remaining IS NULL THEN 'not-found' WHEN f.remaining >= q.quantity THEN 'ok' ELSE 'conflict' END FROM fold f JOIN queue q ON q.sku = f.sku
    AND q.n = f.n + 1)"""


@query("stock_allocation", f"""RECURSIVE chosen AS (SELECT * FROM request), {_ALLOCATE} SELECT q.sku, q.arrival, CAST(q.quantity AS BIGINT) AS quantity,
    f.status, f.remaining FROM queue q JOIN fold f USING (sku, n)""", "request stocks")
def stock_allocation(spark, sf_dir):
    return orders.allocate(given.order_requests(spark, sf_dir), given.stock(spark, sf_dir))


def _customers(spark, sf_dir):
    """Two of three customer names, in capitals."""
    return given.order_requests(spark, sf_dir).select("customer").distinct().where("cast(substr(customer, 2) as int) % 3 <> 0").select(F.upper("customer").alias("customer"))


_OUTCOMES = f"""known AS (SELECT DISTINCT customer FROM request WHERE CAST(substr(customer, 2) AS INTEGER) % 3 <> 0),
    checked AS (SELECT r.*, CAST(r.quantity * r.unit_price AS DECIMAL(38,2)) AS amount, CASE WHEN r.quantity <= 0 THEN 'validation-error' WHEN r.customer
    NOT IN (SELECT customer FROM known) THEN 'not-found' WHEN r.quantity * r.unit_price <= 0 THEN 'validation-error' ELSE 'ok' END AS status FROM request
    r),
    chosen AS (SELECT * FROM checked WHERE status = 'ok'), {_ALLOCATE},
    placed AS (SELECT q.sku, q.arrival, f.status, c.amount, true AS charged, f.status <> 'ok' AS refunded FROM queue q JOIN fold f USING (sku,
    n) JOIN chosen c ON c.sku = q.sku AND c.arrival = q.arrival
        UNION ALL SELECT sku, arrival, status, amount, false, false FROM checked WHERE status <> 'ok')"""


@query("order_outcomes", f"RECURSIVE {_OUTCOMES} SELECT * FROM placed", "request stocks")
def order_outcomes(spark, sf_dir):
    return orders.place(given.order_requests(spark, sf_dir), _customers(spark, sf_dir), given.stock(spark, sf_dir))


@query("net_charged", f"RECURSIVE {_OUTCOMES} SELECT sku, count(*) AS charges, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM placed WHERE charged AND NOT refunded GROUP BY sku", "request stocks")
def net_charged(spark, sf_dir):
    out = order_outcomes(spark, sf_dir).where("charged").withColumn("charge_id", F.concat_ws("-", "sku", "arrival"))
    return orders.net_charged(out, out.where("refunded").select("charge_id"), "sku")


@query("refund_results", "SELECT o_custkey AS charge_id, o_orderkey AS arrival, o_custkey % 4 <> 0 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS refunded FROM orders")
def refund_results(spark, sf_dir):
    requests = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("charge_id"), F.col("o_orderkey").alias("arrival"))
    charges = requests.where("charge_id % 4 <> 0").select("charge_id").distinct()
    return orders.refunds(requests, charges)


_SAGA = """SELECT saga_id, CASE WHEN t AND b AND u THEN 'Succeeded' WHEN t AND sticky THEN 'PartiallyRolledBack' ELSE 'RolledBack' END AS outcome,
    CASE WHEN NOT (t AND b) THEN 0 WHEN NOT u THEN 1 END AS failed_stage,
    CASE WHEN NOT t THEN 'tenant' WHEN NOT b THEN 'billing' WHEN NOT u THEN 'user' END AS failed_step, CASE WHEN NOT t THEN 'validation-error' WHEN NOT b
    THEN 'not-found' WHEN NOT u THEN 'validation-error' END AS failed_status,
    CASE WHEN NOT (t AND b AND u) AND t AND sticky THEN 'tenant' ELSE '' END AS orphans, NOT (t AND b AND u) AND NOT (t AND sticky) AS retry_safe FROM outcome"""


@query("signup_outcomes", _SAGA, "signup outcome")
def signup_outcomes(spark, sf_dir):
    return saga.evaluate_signups(given.signups(spark, sf_dir))


@query("saga_reconciliation", f"SELECT outcome, failed_stage, failed_status, orphans, retry_safe, count(*) AS sagas FROM ({_SAGA}) GROUP BY ALL", "signup outcome")
def saga_reconciliation(spark, sf_dir):
    return saga.reconcile(saga.step_log(given.signups(spark, sf_dir))).groupBy("outcome", "failed_stage", "failed_status", "orphans", "retry_safe").agg(F.count("*").alias("sagas"))


@query("saga_survivors", """SELECT 'tenant' AS kind, count(*) FILTER (t AND ((b AND u) OR sticky)) AS survivors FROM outcome UNION ALL SELECT 'account',
    count(*) FILTER (t AND b AND u) FROM outcome UNION ALL SELECT 'user', count(*) FILTER (t AND b AND u) FROM outcome""", "signup outcome")
def saga_survivors(spark, sf_dir):
    return saga.survivors(given.signups(spark, sf_dir))


@query(
    "saga_survivor_names",
    "SELECT 'tenant' AS kind, company, saga_id FROM outcome WHERE t AND ((b AND u) OR sticky) UNION ALL SELECT unnest(['account', 'user']), company, saga_id FROM outcome WHERE t AND b AND u",
    "signup outcome",
)
def saga_survivor_names(spark, sf_dir):
    return saga.survivor_names(given.signups(spark, sf_dir))


@query(
    "user_command_results",
    """command AS (SELECT event_id AS user_id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS tenant_id, CASE WHEN event_id % 7 = 0 THEN 'nowhere' WHEN event_id
    % 5 = 0 THEN ' ' ELSE concat(event_id, '@x.io') END AS email FROM events)
    SELECT *, CASE WHEN tenant_id IS NULL OR email NOT LIKE '%@%' THEN 'validation-error' ELSE 'ok' END AS status, CASE WHEN tenant_id IS NULL THEN 'tenant'
    WHEN email NOT LIKE '%@%' THEN 'email' END AS error FROM command""",
)
def user_command_results(spark, sf_dir):
    """Every event as a request for a user; some have no tenant, some no address."""
    id_ = F.col("event_id")
    email = F.when(id_ % 7 == 0, "nowhere").when(id_ % 5 == 0, " ").otherwise(F.concat(id_, F.lit("@x.io")))
    commands = read_table(spark, sf_dir, "events").select(id_.alias("user_id"), F.when(id_ % 9 != 0, F.col("user_id")).alias("tenant_id"), email.alias("email"))
    return views.user_commands(commands)


@query("minted_orders", """SELECT o_orderkey, concat('ord-', substr(md5(concat(o_orderkey, '|', o_custkey)), 1, 12)) AS order_id, concat(strftime(CAST(o_orderdate AS TIMESTAMP),
    '%Y-%m-%dT%H:%M:%S'), '.0000000+00:00') AS placed_at FROM orders""")
def minted_orders(spark, sf_dir):
    placed = F.col("o_orderdate").cast("timestamp_ntz")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", mint_id("ord-", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("order_id"), iso_utc(placed).alias("placed_at"))


# ---------------------------------------------------------------- quotes

_GREEKS = """one AS (SELECT symbol, CAST(mid AS DOUBLE) AS s, 0.25 AS v, 0.04 AS r, 30.0 / 365 AS t FROM (SELECT symbol, CAST(mid AS DOUBLE) AS mid FROM marks)),
    two AS (SELECT *, CAST((r + v * v / 2) * sqrt(t) / v AS DOUBLE) AS d1, CAST((r + v * v / 2) * sqrt(t) / v - v * sqrt(t) AS DOUBLE) AS d2 FROM one),
    three AS (SELECT *, 1 / (1 + 0.3275911 * (abs(d1) / sqrt(2.0))) AS t1, 1 / (1 + 0.3275911 * (abs(d2) / sqrt(2.0))) AS t2,
    exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS n1 FROM two),
    four AS (SELECT *, 0.5 * (1 + sign(d1) * (1 - (((((1.061405429 * t1 - 1.453152027) * t1) + 1.421413741) * t1 - 0.284496736)
    * t1 + 0.254829592) * t1 * exp(-d1 * d1 / 2))) AS c1, 0.5 * (1 + sign(d2) * (1 - (((((1.061405429 * t2 - 1.453152027) * t2)
    + 1.421413741) * t2 - 0.284496736) * t2 + 0.254829592) * t2 * exp(-d2 * d2 / 2))) AS c2 FROM three)"""


@query("quote_greeks", f"""{_GREEKS} SELECT symbol, CAST(round(s * 0.9998, 6) AS DECIMAL(18,6)) AS bid, CAST(round(s * 1.0002, 6) AS DECIMAL(18,6))
    AS ask, CAST(round(c1, 6) AS DECIMAL(18,6)) AS delta, CAST(round(n1 / (s * v * sqrt(t)), 6) AS DECIMAL(18,6)) AS gamma,
    CAST(round(s * n1 * sqrt(t) / 100, 6) AS DECIMAL(18,6)) AS vega, CAST(round((-s * n1 * v / (2 * sqrt(t)) - r * s * exp(-r * t)
    * c2) / 365, 6) AS DECIMAL(18,6)) AS theta FROM four""", "marks")
def quote_greeks(spark, sf_dir):
    out = quotes.enrich(given.marks(spark, sf_dir))
    return out.select("symbol", *(F.col(c).cast("decimal(18,6)").alias(c) for c in ("bid", "ask", "delta", "gamma", "vega", "theta")))


def _known(spark, sf_dir):
    """The reference spelling of the symbols that are known: all but `error`."""
    return given.ticks(spark, sf_dir).select(F.initcap("symbol").alias("symbol")).distinct().where("symbol <> 'Error'")


_KNOWN = "known AS (SELECT DISTINCT concat(upper(substr(symbol, 1, 1)), substr(symbol, 2)) AS name, upper(symbol) AS k FROM ticks WHERE symbol <> 'error')"


@query("known_symbol_quotes", f"{_KNOWN} SELECT name AS symbol, count(*) AS quotes, max(seq) AS last_seq FROM ticks JOIN known ON upper(symbol) = k GROUP BY name", "ticks")
def known_symbol_quotes(spark, sf_dir):
    return quotes.known(given.ticks(spark, sf_dir), _known(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("quotes"), F.max("seq").alias("last_seq"))


@query("subscription_ticks", f"{_KNOWN} SELECT name AS symbol, seq, price FROM ticks JOIN known ON upper(symbol) = k QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) <= 25", "ticks")
def subscription_ticks(spark, sf_dir):
    return quotes.subscribe(given.ticks(spark, sf_dir), _known(spark, sf_dir), 25).select("symbol", "seq", "price")


@query("sequence_gaps", """SELECT * FROM (SELECT symbol, lag(seq) OVER (PARTITION BY symbol ORDER BY seq) AS after_seq, seq AS before_seq, before_seq - after_seq - 1 AS missing
    FROM ticks) WHERE missing > 0""", "ticks")
def sequence_gaps(spark, sf_dir):
    return quotes.gaps(given.ticks(spark, sf_dir))


@query("price_snapshot", """SELECT w.symbol, t.seq, t.price, CASE WHEN t.seq IS NULL THEN 'not-found' ELSE 'ok' END AS status FROM (SELECT DISTINCT upper(event_type)
    AS symbol FROM events UNION ALL SELECT 'WEIRDCO') w LEFT JOIN (SELECT symbol, max(seq) AS seq, arg_max(price, seq) AS price FROM ticks GROUP BY symbol)
    t ON upper(t.symbol) = w.symbol""", "ticks")
def price_snapshot(spark, sf_dir):
    asked = given.ticks(spark, sf_dir).select(F.upper("symbol").alias("symbol")).distinct()
    unknown = asked.agg(F.lit("WEIRDCO").alias("symbol"))
    return quotes.snapshot(asked.union(unknown), given.ticks(spark, sf_dir))


@query(
    "watchlist_ticks",
    """changed AS (SELECT *, lag(unwatch, 1, true) OVER (PARTITION BY session_id, symbol ORDER BY seq) AS was FROM watch),
    spans AS (SELECT session_id, symbol, seq AS start, unwatch, lead(seq) OVER (PARTITION BY session_id, symbol ORDER BY seq) AS stop FROM changed WHERE unwatch <> was),
    delivered AS (SELECT s.session_id, s.symbol, s.start, t.seq, 'tick' AS kind FROM spans s JOIN ticks t ON t.symbol = s.symbol AND t.seq > s.start AND (s.stop
    IS NULL OR t.seq < s.stop) WHERE NOT s.unwatch
        UNION ALL SELECT session_id, s.symbol, start, max(t.seq), 'snapshot' FROM spans s JOIN ticks t ON t.symbol = s.symbol AND t.seq <= s.start WHERE NOT
    s.unwatch GROUP BY session_id, s.symbol, start)
    SELECT session_id, symbol, start, kind, count(*) AS ticks, min(seq) AS first_seq, max(seq) AS last_seq FROM delivered GROUP BY ALL""",
    "ticks watch",
)
def watchlist_ticks(spark, sf_dir):
    return quotes.watch_counts(given.ticks(spark, sf_dir), given.watches(spark, sf_dir))
