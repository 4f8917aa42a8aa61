"""The corpus pipeline: quality, toxicity, near duplicates, mixing, packing, in this order over `documents`.

Every stage works on all that its predecessor kept and returns the columns of `documents`; the last returns the
pieces of the packed sequences. Each stage's result is written as Parquet into the shared folder and read again, so
a lost executor costs no more than the stage that runs. What a stage wrote on its way is deleted at its end, its
input after it; what is left at the end is what the result reads.

Defined results, stage by stage. An empty table gives an empty one in every stage; extra columns of `documents`, also
with names that a stage uses itself, pass through the first four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mixing, ngram_join, packing, quality, toxicity
from siltstone.llm.frames import discard, durable, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5.

    Null and empty texts have a score, too, and go or stay by it; equal texts, so repeated rows, go or stay together;
    very long texts are scored whole; null ids count as empty text in choosing folds and are in no sample.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5.

    Null and empty texts hold no toxic words and stay; equal texts go or stay together; very long texts are tagged
    whole; fitting uses only labelled documents of up to 64 KB among those that are left.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id.

    Documents without words (null, empty, blank) are like no other and all stay; of repeated rows one stays; of texts
    that share the smallest id, the one whose set has the smallest name; a null id is chosen if all ids of its group are.
    """
    return ngram_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it: not at all, once or twice.

    Documents without words have size 0 and are never taken; a null source is a source of its own; repeated rows are
    documents of their own; a very long text is taken whole or not.
    """
    return mixing.take(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.

    A null or empty text is its end token; repeated rows are packed as often as they come; very long texts give as many
    whole sequences as they need.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            after = keep(durable(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = after
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    # Packing has stored its pieces.
    discard(docs)
    return pieces
