"""The pipeline's stages against their operators, on a small table."""

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import mixing, ngram_join, packing, quality, textkit, toxicity
from siltstone.llm.queries import QUERIES

from .test_operators import DOCS, SPACE, brute_components, hostile, labelled, plain_features, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    docs, labels = labelled(spark, 300)
    copies = docs.where("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 1000)
    more = hostile(spark).withColumn("doc_id", F.col("doc_id") + 2000).withColumn("extra", F.lit("x")).drop("extra")
    docs.unionByName(copies).unionByName(more).write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{root}/conversations.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "mixing", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = ngram_join.durable(stage(spark, docs, folder))
        assert docs.dtypes == spark.createDataFrame([], DOCS).dtypes, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    pieces = corpus_pipeline.run(spark, folder)
    tokens = sum(len(packing.encode(r.text)) for r in docs.collect())
    assert pieces.agg(F.sum("length")).first()[0] == tokens


def test_stages_are_brute_force(spark, folder):
    """Each stage's rows from its predecessor's: scores row by row, all pairs, targets by source, ids end to end."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda rows: sorted((str(r.doc_id), r.text or "") for r in rows)

    good = ngram_join.durable(stages["quality classifier"](spark, docs, folder))
    model = quality.fit(docs, labels)
    logit = lambda x: float(np.tanh((x - model.mean) / model.scale @ model.w1 + model.b1) @ model.w2 + model.b2)
    assert ids(good.collect()) == ids(r for r in docs.collect() if logit(np.array(plain_features(r.text or ""), dtype=np.float32)) >= 0)

    clean = ngram_join.durable(stages["toxicity"](spark, good, folder))
    model = toxicity.fit(good, labels)
    alone = [next(textkit.slices(pa.array([r.text or ""]))) for r in good.collect()]
    tagged = [model.tag(buf, bounds) for _, _, buf, bounds in alone]
    assert ids(clean.collect()) == ids(r for r, (p, _, _, first) in zip(good.collect(), tagged, strict=True) if model.scores(p, first)[0] < 0.5)

    one = ngram_join.durable(stages["n-gram Jaccard join"](spark, clean, folder))
    rows = clean.collect()
    groups = {c for d, n, c, _ in brute_components(rows) if n}
    # The smallest id of each group; of rows that share it, one.
    assert sorted(str(r.doc_id) for r in one.collect() if shingles(r.text)) == sorted(map(str, groups))
    assert ids(r for r in one.collect() if not shingles(r.text)) == ids(r for r in rows if not shingles(r.text))

    mixed = ngram_join.durable(stages["mixing"](spark, one, folder))
    words = lambda r: len(SPACE.findall(r.text or ""))
    sizes, taken, largest = {}, {}, {}
    for r in one.collect():
        sizes[r.source] = sizes.get(r.source, 0) + words(r)
        largest[r.source] = max(largest.get(r.source, 0), words(r))
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r)
    times = Counter(str(r) for r in mixed.collect())
    held = Counter(str(r) for r in one.collect())
    assert all(times[r] <= 2 * held[r] for r in times)
    for source, target in mixing.targets(sizes, (5, 2, 1), 1.5, 2.0).items():
        assert abs(taken.get(source, 0) - target) <= 2 * largest[source]

    pieces = stages["packing"](spark, mixed, folder).collect()
    expected = Counter()
    for r in mixed.collect():
        expected[r.doc_id, len(packing.encode(r.text))] += 1
    spans, sequences = {}, {}
    for p in pieces:
        spans.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.start + p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.offset + p.length))
    for (doc, tokens), own in spans.items():
        # Every id of every copy lies in one piece.
        cover = Counter(i for a, b in own for i in range(a, b))
        assert set(cover) == set(range(tokens)) and set(cover.values()) == {expected[doc, tokens]}
    assert set(spans) == set(expected)
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(own)) and own[-1][1] <= packing.WINDOW


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_queries_have_their_columns(spark, folder):
    first = {name: QUERIES[name](spark, folder).columns for name in QUERIES}
    assert first["op1_ngram_jaccard_join"][:3] == ["doc_id", "n_shingles", "component_id"]
    assert first["op2_quality_classifier"][:4] == first["op9_toxicity"][:4] == ["doc_id", "held_out", "score", "predicted"]
    assert first["op3_chat_formatting"] == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert first["op8_quality_rules"][:7] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert first["op10_sharding"][:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
