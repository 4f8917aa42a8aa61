"""CSV results per query and client, reports, and scratch folders that all machines share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HEADERS


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; the warehouse where none is set, unless that is a local folder on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) and re.match(r"(file:|/|[^:]*$)", root):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/siltstone-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written to a fresh path and read again, for several queries to read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The file system of a path: what Spark's readers and writers don't do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def move(self, source: str, target: str) -> None:
        """In place of what was there."""
        self.delete(target)
        self.fs.mkdirs(self.path(target).getParent())
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), True)
        out.write(bytearray(text.encode()))
        out.close()


def with_headers(df: DataFrame) -> DataFrame:
    """Columns under their CSV headers."""
    return df.select(*[F.col(f"`{c}`").alias(HEADERS.get(c, c)) for c in df.columns])


def write_csv(df: DataFrame, folder: str, name: str) -> str:
    """One CSV file with a header, overwritten: `folder`/`name`.csv. Meant for results that fit one file."""
    files, staged = Files(df.sparkSession, folder), f"{folder}/_{name}-{uuid.uuid4().hex}"
    with_headers(df).coalesce(1).write.option("header", True).csv(staged)
    files.move(next(f"{staged}/{f}" for f in files.names(staged) if f.startswith("part-")), f"{folder}/{name}.csv")
    files.delete(staged)
    return f"{folder}/{name}.csv"


def clear_clients(spark: SparkSession, folder: str) -> None:
    """Deletes the folders client_* of an earlier run."""
    files = Files(spark, folder)
    for name in files.names(folder):
        if name.startswith("client_"):
            files.delete(f"{folder}/{name}")


def write_clients(results: dict[str, DataFrame], folder: str, clients: list, client: str = "client_id") -> None:
    """`folder`/client_N/query.csv for each client and query, one with a header alone where a client has no rows.

    Each result is computed and written once, a file for each client.
    """
    for name, df in results.items():
        files, staged = Files(df.sparkSession, folder), f"{folder}/_{name}-{uuid.uuid4().hex}"
        rows = with_headers(df.drop(client)).columns
        with_headers(df.withColumnRenamed(client, "_client")).repartition("_client").write.partitionBy("_client").option("header", True).csv(staged)
        for n in clients:
            part = f"{staged}/_client={n}"
            if found := [f for f in files.names(part) if f.startswith("part-")]:
                files.move(f"{part}/{found[0]}", f"{folder}/client_{n}/{name}.csv")
            else:
                files.write(f"{folder}/client_{n}/{name}.csv", ",".join(rows) + "\n")
        files.delete(staged)


def publish(messages: DataFrame, queue: str, keys: list[str] | None = None) -> None:
    """Appends messages (a column `value`) to a queue, a folder of message files that streams read.

    With `keys` one copy goes out under each routing key; an empty list is an error.
    """
    if keys is not None and not keys:
        raise ValueError("no routing keys")
    routed = messages.withColumn("routing_key", F.explode(F.array(*[F.lit(k) for k in keys])) if keys else F.lit(""))
    routed.select("value", "routing_key").write.mode("append").partitionBy("routing_key").parquet(queue)


def consume(spark: SparkSession, queue: str, keys: list[str] | None = None, files_per_trigger: int = 100) -> DataFrame:
    """The queue's messages as a stream, all or those under some of the routing keys (other keys' files aren't read)."""
    stream = spark.readStream.schema("value string, routing_key string").option("maxFilesPerTrigger", files_per_trigger).parquet(queue)
    return stream if keys is None else stream.where(F.col("routing_key").isin(*keys))


def report(results: dict[str, DataFrame]) -> DataFrame:
    """All results in one table, tagged by `query`; columns that a result lacks are null."""
    frames = [df.withColumn("query", F.lit(name)) for name, df in results.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
