"""The registered queries over the derived view."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..operators import graph, payments
from ..sources import files, sinks, views
from ..streaming import payments as streams

S = Settings.for_view()
ROUTES, SAMPLE = 3, 1000
#: A client has a fifth of the payments, so its bounds are lower.
PER_CLIENT = replace(S, destinations=(2, 10), path_pairs=2)


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir).drop("client_id")


def _over_tx(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_tx(spark, sf_dir))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def q2_max_per_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.largest_with_names(_tx(spark, sf_dir), views.accounts(spark, sf_dir), S)


def q5_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.small_converted(_tx(spark, sf_dir), S).agg(F.count("*").alias("n"))


def multi_bank_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("bank"), F.col("c_custkey").alias("account"))
    supplier = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("bank"), F.col("s_suppkey").alias("account"))
    return graph.in_several_banks(customer.unionByName(supplier))


def timestamp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx(spark, sf_dir).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def dataset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sets that the analysis goes through; the first four in one pass over the transactions."""
    tx = _tx(spark, sf_dir)
    usd, p1 = F.col("payment_currency") == S.currency, S.period1.holds(F.col("ts"))
    counted = tx.agg(F.count("*").alias("transactions"), F.count_if(usd).alias("usd"), F.count_if(usd & p1).alias("period1_usd"))
    tall = counted.select(F.expr("stack(3, 'transactions', transactions, 'usd', usd, 'period1_usd', period1_usd) AS (name, n)"))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return tall.unionByName(one("accounts", views.accounts(spark, sf_dir))).unionByName(one("ranged", graph.ranged(tx, S)))


def client_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.counts_per_client(views.transactions(spark, sf_dir))


def q1_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.low_payments(views.transactions(spark, sf_dir), S, ("client_id",))


def q4_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scatter_gather(views.transactions(spark, sf_dir), PER_CLIENT, ("client_id",))


def report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored table of transactions feeds all pipelines; each reads the columns and rows that it needs."""
    tx = sinks.stored(_tx(spark, sf_dir))
    results = {
        "q1": payments.low_payments(tx, S).select("from_bank", "from_account", "amount_paid"),
        "q2": payments.largest_with_names(tx, views.accounts(spark, sf_dir), S).select("from_bank", "from_account", "amount_paid"),
        "q3": payments.far_below_average(tx, S).select("from_bank", "from_account", "amount_paid"),
        "q4": graph.scatter_gather(tx, S).toDF("from_bank", "from_account"),
        "q5": payments.small_converted(tx, S).agg(F.count("*").alias("n")),
    }
    tagged = sinks.report(results)
    # What a result lacks reads as zero or empty here.
    return tagged.na.fill(0, ["from_bank", "amount_paid", "n"]).na.fill("", ["from_account"]).select("query", "from_bank", "from_account", "amount_paid", "n")


def batch_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = views.transactions(spark, sf_dir)
    rows = T.StructType([f for f in tx.schema.fields if f.name != "client_id"])
    return _long(files.from_batches(files.to_batches(tx), rows), "client_id")


def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Amounts as whole numbers: engines spell doubles differently.
    whole = [F.floor(F.col(c) * 10000) for c in ("amount_received", "amount_paid")]
    return files.sample(_tx(spark, sf_dir), SAMPLE, by=[*[F.col(c) for c in ("ts", "from_account", "to_account", "payment_currency", "payment_format")], *whole])


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.head(_tx(spark, sf_dir).select("ts", "from_bank", "from_account", "to_bank", "to_account", "amount_paid"))


def daily_rates(spark: SparkSession) -> DataFrame:
    """A made-up table for the view: each currency's rate, moved by up to 3 % with the day of the month, for four years."""
    days = spark.range(4 * 365 + 1).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    named = F.explode(F.create_map(*[F.lit(x) for pair in S.rates.items() for x in pair])).alias("payment_currency", "base")
    return days.select("day", named).select("payment_currency", "day", (F.col("base") * (1 + F.dayofmonth("day") / F.lit(1000.0))).alias("rate"))


def converted_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.converted_by_day(_tx(spark, sf_dir), daily_rates(spark), S).select("ts", "from_account", "to_account", "payment_currency", "amount_paid", "amount")


def queue_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch messages published under three routing keys and consumed under two: every row comes twice."""
    tx = views.transactions(spark, sf_dir)
    queue = sinks.scratch(spark)
    sinks.publish(files.to_batches(tx, size=1000), queue, ["filter", "joiner", "counter"])
    rows = T.StructType([f for f in tx.schema.fields if f.name != "client_id"])
    received = streams.finished_rows(sinks.consume(spark, queue, ["filter", "counter"]))
    return files.from_batches(received, rows).groupBy("client_id").agg(F.count("*").alias("rows")).select(F.col("client_id").cast("long").alias("client_id"), "rows")


def stream_client_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after the last of several micro-batches."""
    tx = views.transactions(spark, sf_dir)
    after_each = streams.running_counts(streams.in_batches(tx.select("client_id", "ts"), 10**6))
    return after_each.groupBy("client_id").agg(F.max_by("transactions", "batch").alias("transactions"))


def stream_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.low_payments(streams.transaction_stream(spark, sf_dir).drop("client_id"), S)


def stream_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.largest_with_names(streams.transaction_stream(spark, sf_dir).drop("client_id"), views.accounts(spark, sf_dir), S)


def stream_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.far_below_average(streams.transaction_stream(spark, sf_dir).drop("client_id"), S)


def stream_q5_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.small_converted_count(streams.transaction_stream(spark, sf_dir).drop("client_id"), S)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q1_low_usd": _over_tx(lambda tx: payments.low_payments(tx, S)),
    "q2_max_per_bank": q2_max_per_bank,
    "q3_below_avg_fraction": _over_tx(lambda tx: payments.far_below_average(tx, S)),
    "q4_scatter_gather": _over_tx(lambda tx: graph.scatter_gather(tx, S)),
    "q4_pairs": _over_tx(lambda tx: graph.path_pairs(tx, S)),
    "q4_distinct_intermediaries": _over_tx(lambda tx: graph.drawn_scatter_gather(tx, S)),
    "q5_small_converted": _over_tx(lambda tx: payments.small_converted(tx, S)),
    "q5_count": q5_count,
    "usd_only": _over_tx(lambda tx: payments.in_currency(tx, S)),
    "period1_usd": _over_tx(lambda tx: payments.first_period(payments.in_currency(tx, S), S)),
    "period2_usd": _over_tx(lambda tx: payments.second_period(payments.in_currency(tx, S), S)),
    "wire_or_ach": _over_tx(lambda tx: payments.in_formats(tx, S)),
    "converted_amounts": _over_tx(lambda tx: payments.converted(tx, S)),
    "avg_per_format": _over_tx(lambda tx: payments.average_per_format(tx, S).withColumn("average", F.round("average", 6))),
    "max_txn_rows": _over_tx(lambda tx: payments.largest_per_bank(tx, S)),
    "fan_out_degree": _over_tx(lambda tx: graph.fan_out(payments.first_period(payments.in_currency(tx, S), S)).where(F.col("destinations") >= S.drawn_least)),
    "fan_in_degree": _over_tx(lambda tx: graph.fan_in(payments.first_period(payments.in_currency(tx, S), S)).where(F.col("sources") >= S.drawn_least)),
    "ranged_senders": _over_tx(lambda tx: graph.ranged(tx, S)),
    "two_hop_paths": _over_tx(lambda tx: graph.two_hop_paths(tx, S)),
    "bank_accounts_union": _over_tx(graph.bank_accounts),
    "multi_bank_accounts": multi_bank_accounts,
    "timestamp_range": timestamp_range,
    "dataset_sizes": dataset_sizes,
    "client_counts": client_counts,
    "q1_by_client": q1_by_client,
    "q4_by_client": q4_by_client,
    "report_union": report_union,
    "batch_json_roundtrip": batch_json_roundtrip,
    "route_partitions": _over_tx(lambda tx: payments.routed(tx, ROUTES).groupBy("route").agg(F.count("*").alias("n"), F.count_distinct("from_bank").alias("banks"))),
    "sample_n": sample_n,
    "head_rows": head_rows,
    "converted_by_day": converted_by_day,
    "queue_by_key": queue_by_key,
    "stream_client_counts": stream_client_counts,
    "stream_q1": stream_q1,
    "stream_q2": stream_q2,
    "stream_q3": stream_q3,
    "stream_q5_count": stream_q5_count,
}
