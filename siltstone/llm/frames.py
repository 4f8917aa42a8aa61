"""What the corpus operators share on the Spark side: reading, durable cuts of lineage, Arrow mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch between the JVM and Python, so that very long texts can't pile up in one batch.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where it is unset, one of our own in the warehouse, if the whole session runs on this machine or the warehouse is
    no local folder; on a cluster a local one would hold each executor's files apart, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        if not one_machine and re.match(r"(file:|/|[^:]*$)", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = warehouse.rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


#: The open scopes of `scratch`, the innermost last; each lists the paths written within it.
_scopes = threading.local()


def durable(df: DataFrame, *by: str, partitions: int | None = None) -> DataFrame:
    """`df` written as Parquet into the shared folder and read again: lineage ends here, and lost executors lose nothing.

    The files live until the innermost open `scratch` ends, without one as long as the shared folder's own cleaning
    allows, like those of checkpoint().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
    if partitions:
        df = df.repartition(partitions, *by) if by else df.repartition(partitions)
    open_scopes = getattr(_scopes, "open", [])
    if open_scopes:
        open_scopes[-1].append(path)
    df.write.parquet(path)
    return _at(spark.read.schema(df.schema).parquet(path), path)


def _at(df: DataFrame, path: str | None) -> DataFrame:
    df._siltstone_path = path
    return df


def like_stored(df: DataFrame, stored: DataFrame) -> DataFrame:
    """`df`, a view of the table `stored`, to be kept with it."""
    return _at(df, getattr(stored, "_siltstone_path", None))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that `durable` wrote within it, all but those handed to what it yields.

    What leaves the block may read kept tables alone. Kept tables pass to the scope around, if there is one.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    written: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        if not getattr(df, "_siltstone_path", None):
            raise ValueError("only what durable returned can be kept")
        kept.add(df._siltstone_path)
        return df

    _scopes.open.append(written)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scopes.open.pop()
        for path in written:
            if path not in kept:
                _delete(spark, path)
            elif _scopes.open:
                _scopes.open[-1].append(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `durable` wrote and nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_siltstone_path", None):
            _delete(df.sparkSession, path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches bounded in bytes. Workers are used again by later tasks, so each task gives its memory back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back_memory()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def crc_of_id(id_col: str) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def md5_int(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts joined by ':' (nulls empty), 0 to 2**32 - 1; SQL engines agree on it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


_TYPES = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "float": T.FloatType, "string": T.StringType, "boolean": T.BooleanType, "binary": T.BinaryType}


def fields(spec: str) -> T.StructType:
    """'a long, b string' as a schema, without a session; 'spans:a:int,b:int' is an array of structs of integers or strings."""
    out = T.StructType()
    for part in spec.split(", "):
        if ":" in part:
            name, _, inner = part.partition(":")
            members = [m.split(":") for m in inner.split(",")]
            out.add(name, T.ArrayType(T.StructType([T.StructField(n, _TYPES[k]()) for n, k in members])))
        else:
            name, kind = part.split(" ")
            out.add(name, _TYPES[kind]())
    return out


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def give_back_memory() -> None:
    """Returns what a fit has freed to the system, so that the driver doesn't keep its peak for the rest of the job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)
