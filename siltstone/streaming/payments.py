"""Bounded streams of transactions: every query ends when all available files are read.

Row-wise results go to a Parquet sink with exactly-once file commits. Aggregates, small by nature, replace their
table after each micro-batch. Checkpoints and results live in the shared scratch folder, or where the caller says, so
that a query can be restarted. A query that fails is restarted from its checkpoint a few times (`control`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import payments
from ..sources import sinks, views
from . import control


def transaction_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """Line items as a file stream; orders, needed whole, are read before."""
    # A pattern, as a single file is no folder to watch.
    path = f"{sf_dir}/[l]ineitem.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return views.transactions_of(stream, views.table(spark, sf_dir, "orders"))


def in_batches(df: DataFrame, records: int, folder: str | None = None) -> DataFrame:
    """`df` as a stream whose micro-batches hold at most so many records: files of that size, one a trigger."""
    spark = df.sparkSession
    folder = folder or sinks.scratch(spark)
    df.write.option("maxRecordsPerFile", records).parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finished_rows(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Runs a stream without aggregates to its end and returns its rows.

    `out` holds rows and checkpoint. A run that failed, or found more input later, goes on where it was under the same
    `out`, and no row is written twice; without one, each call reads all input.
    """
    out = out or sinks.scratch(stream.sparkSession)
    control.run(lambda: stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).format("parquet").start(f"{out}/rows"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def finished_aggregate(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Runs an aggregate in complete mode to its end and returns the last state of its table; `out` as in `finished_rows`.

    Each batch's table is a folder of its own and the newest is read, so a batch that is run again replaces its own.
    """
    spark, out = stream.sparkSession, out or sinks.scratch(stream.sparkSession)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{number:09d}")

    control.run(lambda: stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).outputMode("complete").foreachBatch(replace).start())
    last = sinks.Files(spark, out).names(f"{out}/rows")[-1:]
    return spark.read.schema(stream.schema).parquet(f"{out}/rows/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def running_counts(stream: DataFrame, out: str | None = None) -> DataFrame:
    """client_id, transactions after each micro-batch (`batch`): totals so far, not each batch's own."""
    spark, out = stream.sparkSession, out or sinks.scratch(stream.sparkSession)
    counted = stream.groupBy("client_id").agg(F.count("*").alias("transactions"))

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    control.run(lambda: counted.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).outputMode("complete").foreachBatch(add).start())
    return spark.read.schema(counted.schema.add("batch", "long")).parquet(f"{out}/rows")


def low_payments(stream: DataFrame, s: Settings) -> DataFrame:
    return finished_rows(payments.low_payments(stream, s))


def largest_with_names(stream: DataFrame, accounts: DataFrame, s: Settings) -> DataFrame:
    best = finished_aggregate(payments.largest_per_bank(stream, s))
    names = accounts.select(F.col("bank_id").alias("from_bank"), "bank_name")
    return best.join(names, "from_bank").select("from_bank", "from_account", "bank_name", "amount_paid")


def small_converted_count(stream: DataFrame, s: Settings) -> DataFrame:
    return finished_aggregate(payments.small_converted(stream, s).groupBy().agg(F.count("*").alias("n")))


def far_below_average(stream: DataFrame, s: Settings) -> DataFrame:
    """Two passes: a stream can't wait for its own average, so its rows are stored first."""
    return payments.far_below_average(finished_rows(stream), s)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, a column `value`. Such a source can't be replayed, so this is for trying things out alone."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
