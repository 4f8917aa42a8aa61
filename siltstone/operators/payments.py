"""Filters, aggregates and joins over transactions. `by` prefixes every key, to keep clients apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings

SENDER, RECEIVER = ("from_bank", "from_account"), ("to_bank", "to_account")
By = tuple[str, ...]


def in_currency(tx: DataFrame, s: Settings) -> DataFrame:
    return tx.where(F.col("payment_currency") == s.currency)


def first_period(tx: DataFrame, s: Settings) -> DataFrame:
    return tx.where(s.period1.holds(F.col("ts")))


def second_period(tx: DataFrame, s: Settings) -> DataFrame:
    return tx.where(s.period2.holds(F.col("ts")))


def low_payments(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    return in_currency(tx, s).where(F.col("amount_paid") < s.small_amount).select(*by, *SENDER, *RECEIVER, "amount_paid")


def largest_per_bank(tx: DataFrame, s: Settings, by: By = (), first: str | None = None) -> DataFrame:
    """Each source bank's row of the largest amount, all columns, aggregated map-side.

    Ties go to the smallest `first` (a line number) or else to the largest of the remaining columns in order. Banks
    without an amount have no row.
    """
    usd = in_currency(tx, s).where(F.col("amount_paid").isNotNull())
    rest = [c for c in tx.columns if c not in ("amount_paid", "from_bank", *by, first)]
    tie = [(-F.col(first)).alias("_tie")] if first else []
    best = usd.groupBy(*by, "from_bank").agg(F.max(F.struct("amount_paid", *tie, *rest)).alias("best"))
    return best.select(*by, "from_bank", "best.amount_paid", *[f"best.{c}" for c in rest])


def largest_with_names(tx: DataFrame, accounts: DataFrame, s: Settings, by: By = (), first: str | None = None) -> DataFrame:
    """The largest payment of each bank, once for each account of that bank."""
    names = accounts.select(*by, "bank_id", "bank_name").withColumnRenamed("bank_id", "from_bank")
    return largest_per_bank(tx, s, by, first).join(names, [*by, "from_bank"]).select(*by, "from_bank", "from_account", "bank_name", "amount_paid")


def average_per_format(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    return first_period(in_currency(tx, s), s).groupBy(*by, "payment_format").agg(F.avg("amount_paid").alias("average"))


def far_below_average(tx: DataFrame, s: Settings, by: By = ()) -> DataFrame:
    """The averages have one row per format (and client); Spark broadcasts them once it has seen their size."""
    later = second_period(in_currency(tx, s), s).select(*by, *SENDER, "payment_format", "amount_paid")
    joined = later.join(average_per_format(tx, s, by), [*by, "payment_format"])
    return joined.where(F.col("amount_paid") < F.col("average") * s.average_fraction).select(*by, *SENDER, "payment_format", "amount_paid")


def converted(tx: DataFrame, s: Settings) -> DataFrame:
    """All rows with `amount` in US dollars; null where the currency has no rate. The rates are a literal map."""
    rates = F.create_map(*[F.lit(x) for pair in s.rates.items() for x in pair])
    return tx.withColumn("amount", F.col("amount_paid") * rates[F.col("payment_currency")])


def day_of(ts: Column, text: bool) -> Column:
    """The day of a timestamp; of one in text form, the first ten characters with either sign between the numbers."""
    return F.try_to_date(F.replace(F.substring(ts, 1, 10), F.lit("/"), F.lit("-"))) if text else ts.cast("date")


def converted_by_day(tx: DataFrame, rates: DataFrame, s: Settings) -> DataFrame:
    """`converted` by a table of rates (payment_currency, day, rate); null where the day has none.

    Spark broadcasts the table if it is small.
    """
    rated = rates.select("payment_currency", F.col("day").alias("_day"), F.col("rate").alias("_rate"))
    dated = tx.withColumn("_day", day_of(F.col("ts"), s.period1.text))
    return dated.join(rated, ["payment_currency", "_day"], "left").select(*tx.columns, (F.col("amount_paid") * F.col("_rate")).alias("amount"))


def in_formats(tx: DataFrame, s: Settings) -> DataFrame:
    return tx.where(F.col("payment_format").isin(*s.formats))


def small_converted(tx: DataFrame, s: Settings) -> DataFrame:
    return converted(in_formats(first_period(tx, s), s), s).where(F.col("amount") < s.converted_below)


def counts_per_client(tx: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    counted = tx.groupBy("client_id").agg(F.count("*").alias("transactions"))
    return counted if accounts is None else counted.join(accounts.groupBy("client_id").agg(F.count("*").alias("accounts")), "client_id", "full")


def routed(tx: DataFrame, n: int, key: str = "from_bank") -> DataFrame:
    """`route`: the worker of n that a row goes to by its key."""
    return tx.withColumn("route", F.col(key) % n)
