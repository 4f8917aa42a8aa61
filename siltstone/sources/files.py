"""CSV files, samples and batch messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema

CORRUPT = "_corrupt_record"


#: Separates nothing that a line of text holds, so that the reader gives whole lines.
_NO_SEPARATOR = "\u0001\u0002\u0001"


def read_csv(spark: SparkSession, path: str, columns=schema.TRANSACTION_COLUMNS, bad_number: float | None = None, streaming: bool = False, files_per_trigger: int = 1, clients: bool = False) -> DataFrame:
    """CSV files or a folder by position, as text first, then typed; each file's first line is its header.

    Numbers that can't be read become `bad_number` (null unless given), NaN becomes null. Rows that are too short or
    too long keep their line in `_corrupt_record`, for `quarantine`. With `clients`, `client_id` is the number N of the
    folder client_N that a file lies in. Lines are read whole and parsed by an expression, so any column can be asked
    for alone.
    """
    reader = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if streaming else spark.read).schema("line string")
    lines = reader.option("header", True).option("sep", _NO_SEPARATOR).option("quote", "\u0000").csv(path)
    raw = T.StructType([*[T.StructField(n, T.StringType()) for n, _, _ in columns], T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_csv("line", raw.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    client = [F.regexp_extract("_metadata.file_path", r"/client_([0-9]+)/", 1).cast("long").alias("client_id")] if clients else []
    # Generated rather than projected, so that a line is parsed once, however many columns are taken from it.
    text = lines.select(*client, F.explode(F.array(parsed)).alias("row"))

    def typed(name: str, kind: T.DataType):
        field = F.col(f"row.{name}")
        if kind == T.StringType():
            return field
        value = field.try_cast(kind)
        if kind == T.DoubleType():
            value = F.nanvl(value, F.lit(None).cast("double"))
        return (value if bad_number is None else F.coalesce(value, F.lit(bad_number).cast(kind))).alias(name)

    return text.select(*[F.col("client_id")] * clients, *[typed(n, t) for n, t, _ in columns], F.col(f"row.{CORRUPT}"))


def quarantine(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole rows without the marker, corrupt rows)."""
    return loaded.where(F.col(CORRUPT).isNull()).drop(CORRUPT), loaded.where(F.col(CORRUPT).isNotNull())


def with_line_numbers(loaded: DataFrame) -> DataFrame:
    """`line`: ascending in the order of each file's rows, with gaps, for ties that go to the first row.

    Parts of one file are dealt out in their order, as equal parts come before the shorter last one.
    """
    return loaded.withColumn("line", F.monotonically_increasing_id())


def head(df: DataFrame, n: int = 5, by: list | None = None) -> DataFrame:
    """The first n rows by `by`, or by all columns: a table has no order of its own."""
    return df.orderBy(*(by or df.columns)).limit(n)


def sample(df: DataFrame, n: int, seed: int = 0, by: list[Column] | None = None) -> DataFrame:
    """n rows without replacement (all, if there are fewer); the same rows for the same seed and input.

    The rows with the smallest MD5 of seed and `by` (all columns unless given). Hashes are even, so all but a few rows
    more than n are left out before anything is sorted; should these be too few, as repeats of a row share their
    hash, all rows are sorted.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in by or [F.col(c) for c in df.columns]]).cast("binary"))
    marked = df.select(F.struct("*").alias("row"), order.alias("hash"))
    total = df.count()
    if total > 4 * n + 1000:
        cut = f"{int(16**8 * (n + 6 * n**0.5 + 50) / total):08x}"
        few = marked.where(F.col("hash") < cut)
        marked = few if few.count() >= n else marked
    return marked.orderBy("hash", "row").limit(n).select("row.*")


def to_batches(df: DataFrame, kind: str = "transactions", client: str = "client_id", size: int = 100) -> DataFrame:
    """client_id, value: JSON messages of at most `size` rows of one client each.

    Rows are numbered within partitions, so making messages shuffles by (client, partition, number / size) alone.
    """
    columns = [c for c in df.columns if c != client]
    numbered = df.withColumn("_chunk", F.monotonically_increasing_id()).withColumn("_chunk", (F.col("_chunk") / size).cast("long"))
    other = "accounts" if kind == "transactions" else "transactions"
    grouped = numbered.groupBy(F.col(client).cast("string").alias("client_id"), "_chunk").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    message = F.struct(F.lit(kind).alias("type"), "client_id", F.col("rows").alias(kind), F.array().cast("array<string>").alias(other))
    return grouped.select("client_id", F.to_json(message).alias("value"))


def from_batches(messages: DataFrame, rows: T.StructType, kind: str = "transactions", value: str = "value") -> DataFrame:
    """client_id and the rows of all messages of the kind; other kinds (eof, ack) and unreadable ones give none."""
    other = {"accounts": schema.TRANSACTIONS} if kind == "accounts" else {}
    shape = schema.batch(rows, schema.ACCOUNTS) if kind == "transactions" else schema.batch(other["accounts"], rows)
    read = messages.select(F.from_json(value, shape).alias("b")).where(F.col("b.type") == kind)
    return read.select("b.client_id", F.inline(f"b.{kind}"))
