"""Transactions and accounts derived from the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import USD_RATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _currency(i):
    return F.element_at(F.array(*[F.lit(c) for c in USD_RATES]), (i % len(USD_RATES) + 1).cast("int"))


def transactions_of(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Works on a stream of line items, too. `client_id` tells five clients apart."""
    base = lineitem.join(orders.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    formats = F.create_map(*[F.lit(x) for pair in (("1", "Wire"), ("2", "ACH"), ("3", "Cheque"), ("4", "Credit Card"), ("5", "Cash")) for x in pair])
    return base.select(
        F.col("l_shipdate").alias("ts"),
        (F.col("o_custkey") % 25).alias("from_bank"),
        F.col("o_custkey").cast("string").alias("from_account"),
        (F.col("l_suppkey") % 12 % 25).alias("to_bank"),
        (F.col("l_suppkey") % 12).cast("string").alias("to_account"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100).alias("amount_received"),
        _currency(F.col("l_suppkey")).alias("receiving_currency"),
        (F.col("l_extendedprice") / 100).alias("amount_paid"),
        F.when(F.col("l_returnflag").isin("A", "R"), "US Dollar").otherwise(_currency(F.col("l_partkey"))).alias("payment_currency"),
        formats[F.substring("o_orderpriority", 1, 1)].alias("payment_format"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_laundering"),
        (F.col("o_orderkey") % 5 + 1).alias("client_id"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("n_nationkey") == F.col("c_custkey") % 25).select(
        F.col("n_name").alias("bank_name"),
        (F.col("c_custkey") % 25).alias("bank_id"),
        F.col("c_custkey").cast("string").alias("account_number"),
        F.col("c_nationkey").cast("string").alias("entity_id"),
        F.col("c_name").alias("entity_name"),
    )
