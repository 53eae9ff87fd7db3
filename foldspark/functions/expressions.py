"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s", " ")) == "", F.lit(True))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def member_of(rows: DataFrame, column: str, table: DataFrame, name: str) -> DataFrame:
    """Add boolean `name`: whether the column's text is in that column of the reference table, ignoring case."""
    keys = table.select(F.lower(column).alias("_key")).distinct().withColumn("_in", F.lit(True))
    return rows.withColumn("_key", F.lower(column)).join(keys, "_key", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_key", "_in")


def first_failure(*rules: tuple[Column, str, str]) -> tuple[Column, Column]:
    """(status, error) of the first rule that fails, else ('ok', null). A rule is (fails, status, error); null is no failure."""
    status, error = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for fails, kind, text in rules:
        status, error = status.when(F.coalesce(fails, F.lit(False)), kind), error.when(F.coalesce(fails, F.lit(False)), text)
    return status.otherwise("ok"), error


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by a polynomial with an absolute error below 1e-7."""
    # Abramowitz and Stegun, formula 7.1.26.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * z)
    series = F.lit(0.0)
    for a in reversed(coefficients):
        series = (series + a) * t
    erf = 1 - series * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


def mint_id(prefix: str, *parts: Column) -> Column:
    """An identifier that follows from what it names: the prefix and twelve hexadecimal digits of a hash of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12))


def iso_utc(time: Column) -> Column:
    """ISO-8601 text of a UTC time, with seven digits of the second and the offset."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS"), F.lit("+00:00"))
