"""Order-insensitive read models: tenants with their users, lookups, rebuild and comparison, lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.expressions import blank, first_failure
from foldspark.functions.fingerprints import difference
from foldspark.operators.logs import read_recorded


def latest_by_version(events: DataFrame, arrival: str | None = None) -> DataFrame:
    """(tenant_id, company, tenant_version): the highest version wins, and of equal ones the later arrival."""
    rank = F.struct("version", F.col(arrival)) if arrival else F.struct("version", "company")
    return events.groupBy("tenant_id").agg(F.max_by("company", rank).alias("company"), F.max("version").alias("tenant_version"))


def users_by_tenant(events: DataFrame) -> DataFrame:
    """(tenant_id, user_count, users): distinct users, by id; of several addresses the one that sorts last."""
    one = events.groupBy("tenant_id", "user_id").agg(F.max("email").alias("email"))
    return one.groupBy("tenant_id").agg(F.count("*").alias("user_count"), F.array_sort(F.collect_list(F.struct("user_id", "email"))).alias("users"))


def tenant_users(tenants: DataFrame, users: DataFrame, arrival: str | None = None) -> DataFrame:
    """(tenant_id, company, tenant_version, user_count, users); users without their tenant make a stub at version 0."""
    both = latest_by_version(tenants, arrival).join(users_by_tenant(users), "tenant_id", "full_outer")
    none = F.array().cast("array<struct<user_id: string, email: string>>")
    zero = F.lit(0).cast("bigint")
    return both.select("tenant_id", F.coalesce("company", F.lit("")).alias("company"), F.coalesce("tenant_version", zero).alias("tenant_version"), F.coalesce("user_count", zero).alias("user_count"), F.coalesce("users", none).alias("users"))


def record(tenants: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """The recorded logs (topic, body, sequence) of tenant and user events, by source."""
    tenant = tenants.select("topic", F.to_json(F.struct("tenant_id", "company", "version")).alias("body"), (F.col("tenant_id") * 1000 + F.col("version")).alias("sequence"))
    user = users.select(F.lit("user:created").alias("topic"), F.to_json(F.struct("user_id", "tenant_id", "email")).alias("body"), F.substring("user_id", 2, 20).cast("bigint").alias("sequence"))
    return {"tenants": tenant, "users": user}


def replay(*logs: tuple[str, DataFrame]) -> DataFrame:
    """All sources' records in one frame; there is no order across sources."""
    return read_recorded(dict(logs))


def tenant_events(records: DataFrame, reverse: bool = False) -> DataFrame:
    """(tenant_id, company, version, arrival) of the recorded tenant events."""
    event = F.from_json("body", "tenant_id bigint, company string, version bigint")
    arrival = F.col("sequence") * (-1 if reverse else 1)
    return records.where(F.col("topic").isin("tenant:created", "tenant:renamed")).select(event.alias("e"), arrival.alias("arrival")).select("e.*", "arrival")


def user_events(records: DataFrame) -> DataFrame:
    """(user_id, tenant_id, email) of the recorded user events."""
    event = F.from_json("body", "user_id string, tenant_id bigint, email string")
    return records.where("topic = 'user:created'").select(event.alias("e")).select("e.*")


def rebuild(logs: dict[str, DataFrame], reverse: bool = False) -> DataFrame:
    """The view from recorded logs alone; unknown topics are skipped. Reversed arrival must give the same view."""
    rows = replay(*logs.items())
    return tenant_users(tenant_events(rows, reverse), user_events(rows), "arrival")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one view that the other one lacks, with the side that has them; none if the views are equal."""
    flat_a, flat_b = (x.withColumn("users", F.to_json("users")) for x in (a, b.select(a.columns)))
    return difference(flat_a, flat_b)


def lookup(requests: DataFrame, view: DataFrame, keys: list[str]) -> DataFrame:
    """One row a request, with status ok or not-found; a miss may also be a row that hasn't arrived yet."""
    found = requests.join(view.withColumn("_found", F.lit(True)), keys, "left")
    return found.withColumn("status", F.when(F.col("_found"), "ok").otherwise("not-found")).drop("_found")


def lag(authority: DataFrame, view: DataFrame) -> DataFrame:
    """(tenant_id, authority_version, view_version, lag) of every key on either side; 0 stands for no version."""
    left = authority.select("tenant_id", F.col("version").alias("authority_version"))
    both = left.join(view.select("tenant_id", F.col("tenant_version").alias("view_version")), "tenant_id", "full_outer").na.fill(0, ["authority_version", "view_version"])
    return both.withColumn("lag", F.col("authority_version") - F.col("view_version"))


def tenant_commands(commands: DataFrame, heads: DataFrame) -> DataFrame:
    """Decide (tenant_id, arrival, kind, company) commands in order of arrival, tenant by tenant.

    Adds status, error and new_version: an accepted create makes the tenant known at version 1 and each accepted rename
    raises its version by one, for the commands after it too. A blank company is a validation error; renaming an unknown
    tenant is not-found and creating a known one a conflict. No two commands of a tenant have the same arrival.
    """
    queue = Window.partitionBy("tenant_id").orderBy("arrival")
    creates = (F.col("kind") == "create") & ~blank(F.col("company"))
    created = F.coalesce(F.max(creates).over(queue.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    both = commands.join(heads.select("tenant_id", F.col("version").alias("_head")), "tenant_id", "left").withColumn("_known", F.col("_head").isNotNull() | created)
    status, error = first_failure(
        (blank(F.col("company")), "validation-error", "company"),
        ((F.col("kind") == "rename") & ~F.col("_known"), "not-found", "tenant"),
        ((F.col("kind") == "create") & F.col("_known"), "conflict", "exists"),
    )
    decided = both.withColumns({"status": status, "error": error})
    accepted = F.count(F.when(F.col("status") == "ok", 1)).over(queue.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return decided.withColumn("new_version", F.when(F.col("status") == "ok", F.coalesce("_head", F.lit(0)) + accepted).cast("bigint")).drop("_head", "_known")


def user_commands(commands: DataFrame) -> DataFrame:
    """Decide (user_id, tenant_id, email) commands; the tenant need not exist."""
    status, error = first_failure((blank(F.col("tenant_id").cast("string")), "validation-error", "tenant"), (blank(F.col("email")) | ~F.col("email").contains("@"), "validation-error", "email"))
    return commands.withColumns({"status": status, "error": error})
