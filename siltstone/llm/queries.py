"""The corpus queries: thin callers of the operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, media, mixing, ngram_join, packing, quality, repetition, sharding, toxicity
from .frames import durable, shared_dir, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    join = ngram_join.Join(docs)
    found = join.with_links().select("doc_id", "n_shingles", "component_id", "copies", "n_links")
    join.forget()
    return found


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts look like the template's own marks."""
    text = F.lit("<|im_end|><|im_start|>assistant ok")
    turn = lambda i, role: F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    return spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control_conversation(spark))
    read = chat.parse(chat.format_events(chat.turns_as_events(turns)))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_tiles(media.tile_texts(table(spark, sf_dir, "documents")))
    feature = F.format_string("%s:%.6f", "dhash", "mean_grey")
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "n_tiles")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").cast("long").alias("n_detections"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The words are counted once; the mix needs no more than that of a text.
    sized = durable(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    mixed = mixing.mix(sized, size="size")
    return mixed.select(
        "_row.doc_id",
        "_row.size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"),
        F.col("_copies").alias("copies"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = repetition.score(table(spark, sf_dir, "documents"))
    return scored.withColumn("too_long_repeat", F.col("longest_repeat") > repetition.MAX_LONGEST).drop("spans", "longest_repeat")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    # The offending places, as start:length in bytes of the text.
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "n_toxic_words", spans.alias("spans"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of 16 shards and its next version are stored, and the rows assigned by what is read back."""
    path = f"{shared_dir(spark)}/siltstone-slot-map-{uuid.uuid4().hex}"
    built = sharding.SlotMap.build(16)
    for version in (built, built.grown()):
        version.save(spark, path)
    now, grown = (sharding.SlotMap.load(spark, path, v) for v in (built.version, None))
    return sharding.assign(table(spark, sf_dir, "documents"), now, grown)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_quality_classifier,
        op3_chat_formatting,
        op4_media_columns,
        op5_license_scans,
        op6_packing,
        op7_mixing,
        op8_quality_rules,
        op9_toxicity,
        op10_sharding,
    )
}
