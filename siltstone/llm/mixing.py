"""Mixing sources to target weights by systematic sampling.

Targets: each source's share of the budget by weight, at most `cap` times its size; what the cap takes away is
shared out again by weight until no source is above. A source's documents then all expect the same number of
copies, target / source size. Their expected copies are prefix-summed within the source, one random offset is
added, and a document is emitted once for every integer boundary that its interval crosses.

The documents of a source are summed in the order of size class (sizes within about 3 %), then of a keyed
hash, so each size class is sampled evenly and the words taken come near the target.

The prefix sum has three levels, none of which brings a source into one task: totals per size class, totals
per hash bucket within a class, and rows within a bucket. Buckets are as many as the source's rows need.

Defined results: null text has size 0; the null source is a source of its own, last in order; a source of
size 0 has target 0 and takes nothing; repeated rows are separate documents; equal rows tie and are numbered
in any order, all with the same result in sum; a very long text is one document, counted in the JVM without being
split; an empty table gives no rows; extra columns, whatever their names, are kept.

A bucket is what one task sorts. Rows are spread over buckets by a hash of id and size; rows that share a source, an id
and a size meet in one, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import durable, md5_int, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one bucket holds on average at most.
BUCKET_ROWS = 4_096
#: Up to so many sources their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, cap: float) -> dict[str | None, float]:
    """Words to take from each source. Sources by code point, null last, take the weights in turn."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    # By the room that a unit of weight has: whoever reaches the cap at the present level is settled for good.
    left, rest = share * sum(sizes.values()), float(sum(weight.values()))
    out: dict[str | None, float] = {}
    for s in sorted(order, key=lambda s: (cap * sizes[s] / weight[s], order.index(s))):
        out[s] = min(cap * sizes[s], left * weight[s] / rest) if rest else 0.0
        left -= out[s]
        rest -= weight[s]
    return out


def sources_of(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """skey, source_size, target, copies, buckets, offset: one row per source, all in DataFrame functions.

    Sorted by room per weight, a source is capped if its room is no more than the level that the sources before
    it leave; the same settling rule as `targets`, written with running sums. The windows have one row per source.
    """
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy("room", "skey").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(everything.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    per = (
        sized.groupBy("skey")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        .withColumn("weight", weight)
        .withColumn("room", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(earlier), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("level", (F.lit(float(share)) * F.col("total") - F.lit(float(cap)) * F.col("size_before")) / F.col("weight_left"))
        # The level of the first source that isn't capped holds for all later ones.
        .withColumn("water", F.min(F.when(F.col("room") > F.col("level"), F.struct("room", "skey", "level"))).over(everything)["level"])
    )
    capped = F.col("water").isNull() | (F.col("room") <= F.col("water"))
    return per.withColumn("target", F.when(capped, F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("weight") * F.col("water"))).select(
        "skey",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies"),
        F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"),
        (md5_int(F.lit("offset"), F.col("skey")) / F.lit(4294967296.0)).alias("offset"),
    )


def size_class(size: Column) -> Column:
    """The size cut to its six leading bits: one class holds sizes within about 3 %."""
    unit = F.expr("shiftleft(1L, greatest(0, length(bin(_size)) - 6))")
    return size - size % unit


def _placed(df: DataFrame, key: str) -> DataFrame:
    """Adds what orders a source's rows: size class, bucket of the keyed hash, the hash itself.

    The size is hashed along, so rows that share an id are spread by their sizes.
    """
    return (
        df.withColumn("_class", size_class(F.col("_size")))
        .withColumn("_hash", md5_int(F.col(key), F.col("_size")))
        .withColumn("_bucket", F.floor(F.col("_hash") * F.col("buckets") / F.lit(4294967296.0)))
    )


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None) -> DataFrame:
    """All rows of `df`: _row (a struct of its columns), _size, _source_size, _target, _copies (how often the mix holds it).

    `size` names a column that holds the sizes already; otherwise they are the words of `text`.
    """
    # The row travels as one struct, so that none of its columns can clash with those added here. The size is
    # generated rather than projected, so that counting isn't repeated wherever it is used.
    boxed = df.select(F.struct("*").alias("_row"))
    sized = boxed.select("_row", F.col(f"_row.{key}").alias("_key"), F.explode(F.array(F.col(f"_row.{size}") if size else n_words(F.col(f"_row.{text}")))).alias("_size"))
    # "0" before a name, "1" for none: by code point, null last.
    sized = sized.withColumn("_skey", F.coalesce(F.concat(F.lit("0"), F.col(f"_row.{source}").cast("string")), F.lit("1")))
    with scratch(df.sparkSession) as keep:
        narrow = durable(sized.select("_key", "_size", "_skey"))
        per_source = keep(durable(sources_of(narrow.select(F.col("_size").alias("size"), F.col("_skey").alias("skey")), weights, share, cap).withColumnRenamed("skey", "_skey"), partitions=1))
        if per_source.count() <= BROADCAST_SOURCES:
            per_source = F.broadcast(per_source)
        buckets = _placed(narrow.join(per_source.select("_skey", "buckets"), "_skey"), "_key").groupBy("_skey", "_class", "_bucket").agg(F.count("*").alias("n"))
        buckets = keep(durable(buckets))
    running = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    classes = buckets.groupBy("_skey", "_class").agg(F.sum("n").alias("class_n"))
    classes = classes.withColumn("class_before", F.coalesce(F.sum("class_n").over(running("_skey", "_class")), F.lit(0)))
    buckets = buckets.withColumn("bucket_before", F.coalesce(F.sum("n").over(running("_skey", "_class", "_bucket")), F.lit(0)))
    before = buckets.join(classes, ["_skey", "_class"]).select("_skey", "_class", "_bucket", (F.col("class_before") + F.col("bucket_before")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_skey", "_class", "_bucket").orderBy("_hash", F.col("_key").asc_nulls_first(), "_size"))
    rows = _placed(sized.join(per_source, "_skey"), "_key").withColumn("_nth", nth).join(before, ["_skey", "_class", "_bucket"])
    rank = F.col("_before") + F.col("_nth")
    crossed = F.floor(F.col("offset") + rank * F.col("copies")) - F.floor(F.col("offset") + (rank - 1) * F.col("copies"))
    return rows.select(
        "_row",
        "_size",
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.when(F.col("_size") > 0, F.least(crossed, F.ceil("copies"))).otherwise(0).cast("int").alias("_copies"),
    )


def take(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `df` as many times as the mix holds it, with the columns of `df`."""
    return mix(df, **options).withColumn("_nth", F.explode(F.sequence(F.lit(0), F.col("_copies")))).where(F.col("_nth") > 0).select("_row.*")
