"""The corpus operators against brute force, round trips, and hostile rows."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, components, frames, licenses, media, mixing, ngram_join, packing, quality, repetition, sharding, textkit, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def hostile(spark):
    """Nulls in every column, empty and blank texts, a long one, ties, repeated rows, odd code points."""
    rows = [
        (None, None, None, None, None),
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \t\n ", None, None, 3),
        (4, "one two", "en", "b", 7),
        (4, "one two", "en", "b", 7),
        (5, "ONE two", "en", "b", 7),
        (6, "word " * 30_000, "en", "a", 150_000),
        (7, "é<|endoftext|>\U0001f600  x \\ <| <\\|", "xx", "\U0001f600", 9),
        (None, "a b c d e f g", "en", "b", 13),
        (8, "a b c d e f g", "en", "b", 13),
    ]
    return spark.createDataFrame(rows, DOCS)


def corpus(spark, n=160, seed=3):
    """Random texts with exact copies, near copies and a shared passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    texts, passage = [], " ".join(word() for _ in range(60))
    for i in range(n):
        kind = i % 8
        if kind < 4 or not texts:
            texts.append(" ".join(word() for _ in range(rng.choice([0, 2, 5, 40, 150]))))
        elif kind == 4:
            texts.append(rng.choice(texts))
        elif kind == 7:
            texts.append(" ".join(word() for _ in range(40)) + "\n" + passage)
        else:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words).upper() if kind == 5 else " ".join(words))
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], DOCS)


def shingles(text, size=5):
    words = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows):
    sets = [shingles(r.text) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
            links[i] += 1
            links[j] += 1
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = lambda g: min((rows[i].doc_id for i in g if rows[i].doc_id is not None), default=None)
    return sorted(((r.doc_id, len(s), least(groups[find(i)]), links[i]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("make", [corpus, hostile])
def test_join_is_brute_force(spark, make):
    df = make(spark)
    got = ngram_join.Join(df).with_links().select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(df.collect())


def test_links_are_counted_alike_in_chunks_of_any_size(spark, monkeypatch):
    df = corpus(spark, 200, seed=5)
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 2)
    monkeypatch.setattr(ngram_join, "_FRAGMENT", 7)
    got = ngram_join.Join(df).with_links().select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(df.collect())
    assert ngram_join.Join(df.limit(0)).with_links().count() == 0


def test_join_all_links(spark):
    df = corpus(spark)
    join = ngram_join.Join(df, all_links=True)
    texts = {}
    for r in df.collect():
        if shingles(r.text):
            texts.setdefault(frozenset(shingles(r.text)), r.doc_id)
    expected = sum(100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(texts, 2))
    assert join.links.count() == expected > 0


def test_join_keeps_one_of_each(spark):
    df = corpus(spark).unionByName(hostile(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    kept = ngram_join.one_of_each(df).collect()
    rows = df.collect()
    groups = {c for d, n, c, _ in brute_components(rows) if n}
    assert sum(bool(shingles(r.text)) for r in kept) == len(groups) and sum(not shingles(r.text) for r in kept) == sum(not shingles(r.text) for r in rows)
    wide = ngram_join.one_of_each(df.withColumns({c: F.lit("?") for c in CLASHES})).collect()
    what = lambda found: sorted(str((r.doc_id, sorted(shingles(r.text)))) for r in found)
    assert what(wide) == what(kept)
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_pieces_do_not_grow_with_the_number_of_fragments(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    size = {}
    for fragments in (16, 1024):
        rows = ngram_join._pieces(df, ngram_join._sets_of_texts(5), fragments).toArrow()
        size[fragments] = rows.nbytes
        assert len(set(rows["fragment"].to_pylist())) == fragments and rows["names"].null_count == len(rows) - len(set(rows["block"].to_pylist()))
    assert size[1024] <= 1.2 * size[16]


def test_shared_ngrams_are_brute_force(spark, monkeypatch):
    """In many small blocks and fragments: a class is found if others hold `percent` of it, whatever else is."""
    df = corpus(spark, 200, seed=8).repartition(5)
    sets = {}
    for r in df.collect():
        if own := frozenset(shingles(r.text)):
            sets.setdefault(own, 0)
            sets[own] += 1
    held = {}
    for own in sets:
        for g in own:
            held[g] = held.get(g, 0) + 1
    alone = {len(own) for own in sets if 100 * sum(held[g] > 1 for g in own) < 80 * len(own) and sets[own] == 1}
    sharing = sum(100 * sum(held[g] > 1 for g in own) >= 80 * len(own) for own in sets)
    for grams, places in ((400, 1 << 15), (10**6, 3)):
        monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", places)
        monkeypatch.setattr(ngram_join, "FRAGMENT_GRAMS", 50)
        join = ngram_join.Join(df)
        assert join.sets.count() == sharing and alone, (grams, places)


def test_ngrams_of_one_fragment():
    grams = np.array([5, 5, 9, 7, 9, 1], dtype=np.uint32)
    places = np.array([0, 0, ngram_join._SEVERAL, 3, 1, 2], dtype=np.uint16)
    assert ngram_join.held_by_others(places, grams).tolist() == [True, True, False, False, True, False]
    local, split = ngram_join.split_block(np.array([2, 1, 1]), np.array([1 << 63, 3, 3, 4], dtype=np.uint64), 2)
    assert local.tolist() == [1, 1, 0] and [(f, p.tolist(), g.tolist()) for f, p, g in split] == [(0, [ngram_join._SEVERAL, 2], [3, 4]), (1, [0], [0])]


def test_scratch_tables_are_deleted(spark):
    import os

    there = lambda d: any(os.path.exists(f.removeprefix("file://")) for f in d.inputFiles())
    with frames.scratch(spark) as keep:
        kept, lost = keep(frames.durable(spark.range(3))), frames.durable(spark.range(3))
        with frames.scratch(spark) as inner:
            passed, gone = inner(frames.durable(spark.range(2))), frames.durable(spark.range(2))
            files = gone.inputFiles()
        assert there(passed) and not any(os.path.exists(f.removeprefix("file://")) for f in files)
        keep(passed)
        of_lost = lost.inputFiles()
        with pytest.raises(ValueError):
            keep(kept.select("id"))
    assert there(kept) and kept.count() == 3 and passed.count() == 2 and not any(os.path.exists(f.removeprefix("file://")) for f in of_lost)


def test_shared_folder_is_never_a_local_one_on_a_cluster(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
            self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: Conf()})()

    found = lambda master, **conf: frames.shared_dir(Session(master, **conf))
    assert found("yarn", spark_checkpoint_dir="hdfs://a/b/") == "hdfs://a/b" and found("local[4]", spark_sql_warehouse_dir="/w") == "/w/_checkpoints"
    assert found("yarn", spark_sql_warehouse_dir="s3a://w") == "s3a://w/_checkpoints"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:1"):
        for folder in ("/w", "file:/w", "file:///w", "w"):
            with pytest.raises(ValueError):
                found(master, spark_sql_warehouse_dir=folder)


def test_chains_across_stars_are_found(spark):
    """Neighbours link, ends don't: connecting them needs every link of the chain."""
    base = [f"w{i}" for i in range(104)]
    rows = [(100 - k, " ".join(base[:-1] + ["x"] if k == 9 else [f"c{k}_{i}" if i < 4 * k and i % 4 == 0 and False else w for i, w in enumerate(base[2 * k :] + [f"n{j}" for j in range(2 * k)])]), "en", "s", 0) for k in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    got = ngram_join.Join(df).with_links().select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(df.collect())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (30, 40), (50, 50), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 40: 30}


def test_word_hashes_depend_on_bytes_alone():
    texts = pa.array(["ab cd ab", "cd  ab\tq", None, "x" * 5000 + " ab"])
    for limit in (4, 1 << 20):
        found = {}
        for _, _, buf, bounds in textkit.slices(texts, limit):
            starts, ends, _ = textkit.word_bounds(buf, bounds)
            for a, b, h in zip(starts, ends, textkit.word_hashes(buf, starts, ends, 64), strict=True):
                assert found.setdefault(buf[a:b].tobytes(), h) == h
        assert set(found) == {b"ab", b"cd", b"q", b"x" * 5000} and len(set(found.values())) == 4


def test_chat_events_fold(spark):
    events = [
        (1, 0, "message", "m0", "user", "hi"),
        (1, 2, "delta", "m1", "assistant", "wor"),
        (1, 1, "delta", "m1", "assistant", "wrong "),
        (1, 3, "regenerate", "m1", "assistant", None),
        (1, 4, "delta", "m1", "assistant", "<|im_"),
        (1, 5, "delta", "m1", "assistant", "end|>\\"),
        (1, 6, "message", "m2", "user", "old"),
        (1, 7, "edit", "m2", None, "new"),
        (1, 8, "message", "m3", "assistant", "gone"),
        (1, 9, "delete", "m3", None, None),
        (None, None, "message", None, None, None),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, message string, role string, text string")
    got = {r.conv_id: r for r in chat.parse(chat.format_events(df)).collect()}
    assert [tuple(m) for m in got[1].messages] == [("user", "hi"), ("assistant", "<|im_end|>\\"), ("user", "new")]
    assert got[1].loss_texts == ["<|im_end|>\\"]
    assert [tuple(m) for m in got[None].messages] == [("", "")]
    assert chat.format_events(df.limit(0)).count() == 0


def test_chat_message_without_a_role(spark):
    events = [(1, 0, "delta", "m", None, "a"), (1, 1, "delta", "m", "", "b"), (1, 2, "delta", "n", "user", "c")]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, message string, role string, text string")
    (got,) = chat.parse(chat.format_events(df)).collect()
    assert [tuple(m) for m in got.messages] == [("", "ab"), ("user", "c")]


def test_chat_events_of_all_kinds_pass_the_fold(spark):
    events = [
        (1, 0, "message", "m", "user", "a"),
        (1, 1, None, "m", "user", "x"),
        (1, 2, "typing", "m", "user", "y"),
        (1, 3, "Delta", "m", "user", "b"),
        *[(1, 4, kind, None, "assistant", "c") for kind in ("message", "message", "delta", "edit", "regenerate", "delete", "typing", None)],
        (2, 0, "message", "m", "user", "gone"),
        (2, 1, "delete", "m", None, None),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, message string, role string, text string")
    got = {r.conv_id: [tuple(m) for m in r.messages] for r in chat.fold(df).collect()}
    assert got == {1: [("user", "ab"), *[("assistant", "c")] * 4], 2: []}
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    folded = chat.fold(chat.turns_as_events(turns))
    assert "element_at(log" in folded._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(m) for m in folded.first().messages] == [("user", "a"), ("user", "b"), ("user", "b"), ("", "")]


def test_chat_of_long_texts_repeated_rows_and_clashing_columns(spark):
    long = "<|im_end|>\\ word " * 100_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (1, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    clashes = {c: F.lit("?") for c in ("kind", "message", "seq", "own", "log", "last", "live", "kept", "m", "messages", "parts", "formatted", "loss_spans", "at", "late", "delta")}
    for rows in (df, df.withColumns(clashes)):
        (got,) = chat.parse(chat.format_events(chat.turns_as_events(rows))).collect()
        assert [tuple(m) for m in got.messages] == [("user", long), ("assistant", long), ("assistant", long), ("", "")] and got.loss_texts == [long, long]
    events = chat.turns_as_events(df).withColumns({c: F.lit("?") for c in ("own", "log", "last", "live", "kept", "m", "parts", "formatted", "at")})
    assert chat.format_events(events).count() == 1


def test_chat_round_trip_of_odd_texts(spark):
    parts = ["<|im_end|>", "<|", "\\", "<", "|", "\n", "<\\|", "%0A", "\U0001f600", ""]
    turns = [(i, t, r, a + b + c) for i, (a, b, c) in enumerate(itertools.product(parts, repeat=3)) for t, r in enumerate(["us%0A\ner<|", "assistant"])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for r in chat.parse(chat.format_events(chat.turns_as_events(df))).collect():
        text = turns[2 * r.conv_id][3]
        assert [tuple(m) for m in r.messages] == [("us%0A\ner<|", text), ("assistant", text)] and r.loss_texts == [text]


def test_media_formats():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(b"P5 #c\n7 5\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P2\n7 5 255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P6\n7 5\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P5\n7 5\n65535\n" + grey.astype(">u2").tobytes()) == grey).all()
    assert (media.decode(b"P1\n2 2\n1 0\n0 1") == [[0, 255], [255, 0]]).all()
    assert (media.decode(b"P4\n2 2\n\x80\x40") == [[0, 255], [255, 0]]).all()
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * 3 for r in colour[::-1])
    head = (54 + len(rows)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (7).to_bytes(4, "little") + (5).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"\0" * 24
    assert (media.decode(b"BM" + head + rows) == colour).all()
    assert media.tile_one(b"junk")["error"] and media.tile_one(None)["npy"] is None and media.tile_one(b"P5\n9 9\n255\nxx")["error"]


def bmp(width, height, bits, kind=0, body=b"", masks=b""):
    i = lambda x, n=4: x.to_bytes(n, "little", signed=True)
    start = 54 + len(masks)
    return b"BM" + i(start + len(body)) + i(0) + i(start) + i(40) + i(width) + i(height) + i(1, 2) + i(bits, 2) + i(kind) + b"\0" * 20 + masks + body


def test_media_masks():
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    mask = lambda *shifts: b"".join((0xFF << s).to_bytes(4, "little") for s in shifts)
    assert (media.decode(bmp(3, -2, 32, 0, pixels.tobytes())) == pixels[:, :, [2, 1, 0]]).all()
    assert (media.decode(bmp(3, -2, 32, 3, pixels.tobytes(), mask(0, 8, 16))) == pixels[:, :, :3]).all()
    assert (media.decode(bmp(3, -2, 32, 3, pixels.tobytes(), mask(24, 16, 8))) == pixels[:, :, [3, 2, 1]]).all()
    assert media.tile_one(bmp(3, -2, 32, 3, pixels.tobytes(), mask(0, 4, 16)))["error"] == "masks not read"
    assert media.tile_one(bmp(3, 2, 24, 3, pixels.tobytes()))["error"] == "kind of BMP not read"


def test_media_never_fails(spark):
    big = b"9" * 20
    bad = [
        b"P5\n" + big + b" 1\n255\nx",
        b"P4\n" + big + b" 1\nx",
        b"P2\n1 1\n255\n" + big,
        b"P2\n1 1\n255\n256",
        b"P3\n1 1\n255\n1 2 -3",
        b"P2\n1 1\n255\nabcde",
        b"P5\n-1 1\n255\nx",
        b"P5\n1_0 1\n255\nxxxxxxxxxx",
        b"P6\n" + b"9" * 5000 + b" 1 255\n",
        bmp(2**31 - 1, 2**31 - 1, 24),
        bmp(2**31 - 1, -(2**31), 1),
        bmp(1, 1, 8, 0, b"\xff" * 4),
        b"BM",
        b"",
    ]
    rng = random.Random(3)
    good = [b"P5\n2 2\n255\nabcd", b"P2 2 1 9 1 2", bmp(1, 1, 24, 0, b"abcd")]
    for _ in range(3000):
        image = bytearray(rng.choice(good))
        for _ in range(rng.randint(1, 4)):
            image[rng.randrange(len(image))] = rng.randrange(256)
        assert media.tile_one(bytes(image))["npy"] or media.tile_one(bytes(image))["error"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*bad, *good, None])], "doc_id long, image binary")
    got = {r.doc_id: r for r in media.read_tiles(media.tile_images(df, "doc_id", "image")).collect()}
    assert all(got[i].error and got[i].n_tiles is None and got[i].dhash is None for i in range(len(bad)))
    assert all(got[len(bad) + i].n_tiles == 1 and len(got[len(bad) + i].dhash) == 16 for i in range(len(good))) and got[len(bad) + len(good)].error is None


def test_media_hashes_are_of_the_stored_tiles():
    rng = np.random.default_rng(2)
    for shape in ((24, 24), (50, 30), (25, 49, 3), (1, 1)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        stored = media.npy_bytes(media.to_tiles(image))
        assert (media.from_tiles(media.read_npy(stored), *shape[:2]) == image).all()
        assert media.read_one(stored, *shape[:2])["dhash"] == media.difference_hash(image)
        assert media.read_one(media.npy_bytes(media.to_tiles(255 - image)), *shape[:2])["dhash"] != media.difference_hash(image) or shape == (1, 1)


def test_media_resize_and_tiles():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (48, 54), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 8, 9), image.reshape(8, 6, 9, 6).mean((1, 3)))
    assert np.isclose(media.area_resize(image, 5, 7).mean(), image.mean())
    tiles = media.to_tiles(image)
    assert tiles.shape == (6, 24, 24) and (tiles[0] == image[:24, :24]).all() and (tiles[2][:, 6:] == media.PAD).all()
    import io

    assert (np.load(io.BytesIO(media.npy_bytes(tiles))) == tiles).all() and (media.read_npy(media.npy_bytes(tiles)) == tiles).all()


def test_media_columns_of_texts(spark):
    df = hostile(spark)
    got = media.read_tiles(media.tile_texts(df)).collect()
    expected = []
    for r in df.collect():
        body = (r.text or "").encode()
        body += b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        expected.append((r.doc_id, len((r.text or "").encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(expected, key=str)
    assert media.tile_texts(df.limit(0)).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({label for _, label in places}))


def test_licenses(spark):
    texts = ["MIT License mit-license", "Licensed under CC BY-NC 4.0.", "É the GNU General\nPublic License, version 3, x", "SPDX-License-Identifier: Apache-2.0", "mit licenses", None, "", "apache license apache license"]
    rng = random.Random(1)
    vocabulary = ["mit", "license", "cc", "by", "gnu", "general", "public", "apache", "x", "é", "Version", "2.0"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute_base(t), t
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(","))) and 0 <= got[i].score <= 1
        spans = [(d.first_word, d.end_word) for d in got[i].detections]
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] and x.priority <= y.priority for (a, x), (b, y) in itertools.permutations(zip(spans, got[i].detections, strict=True), 2))
    assert got[1].labels == "cc-by,cc-by-nc-4.0" and got[2].labels == "gpl,gpl-3.0" and got[3].labels == "apache-2.0"
    assert licenses.scan(hostile(spark)).count() == 11 and licenses.scan(df.limit(0)).count() == 0


def test_license_rules_are_hundreds_of_lines():
    lines = [x for block in (licenses.FAMILIES, licenses.ADDRESSES, licenses.NOTICES) for x in block.strip().splitlines()]
    assert len(lines) == len(set(lines)) > 250 and len(licenses.rules()) > 500 and all(r.keywords and r.reach < 300 for r in licenses.rules())


def plain_places(words):
    """Every rule tried on the whole text, and every detection compared with every survivor."""
    found = sorted((r.priority, m.start() - m.end(), i, m.start(), m.end()) for i, r in enumerate(licenses.rules()) for m in r.pattern.finditer(words))
    kept = []
    for priority, _, i, start, end in found:
        if not any(a <= start and end <= b for a, b, *_ in kept):
            kept.append((start, end, licenses.rules()[i].label, priority, licenses.rules()[i].score))
    return sorted(kept)


def test_license_suppression_is_brute_force():
    rng = random.Random(11)
    pieces = [some_match(re._parser.parse(r.pattern.pattern), rng) for r in licenses.rules()]
    pieces = [p for p in pieces if not re.search("[^a-z0-9 ]", p)] + ["mit license", "cc by", "the", "under", "license", "gnu", "version 2 0", "by nc"]
    for _ in range(60):
        words = " " + " ".join(" ".join(rng.choice(pieces).split()[: rng.choice([1, 2, 3, 99])]) for _ in range(rng.randint(1, 25))) + " "
        assert licenses.places(words) == plain_places(words), words
    intervals = [(rng.randrange(3), rng.randrange(4), a, a + rng.randint(1, 12)) for a in (rng.randrange(40) for _ in range(300))]
    for n in range(0, 300, 7):
        kept = []
        for k in sorted(range(n), key=lambda k: (intervals[k][0], intervals[k][2] - intervals[k][3], intervals[k][1], intervals[k][2])):
            if not any(intervals[j][2] <= intervals[k][2] and intervals[k][3] <= intervals[j][3] for j in kept):
                kept.append(k)
        bounds = lambda ks: sorted((intervals[k][0], *intervals[k][2:]) for k in ks)
        assert not n or bounds(licenses.surviving(intervals[:n])) == bounds(kept)


def test_license_scan_of_a_text_full_of_detections_is_quick():
    start = time.time()
    got = licenses.scan_words(" " + "mit license " * 50_000)
    assert (got["n_base"], got["last_word"], got["detections"][-1]["end_word"]) == (50_000, 99_998, 100_000) and time.time() - start < 2


def some_match(parsed, rng):
    """A text that the parsed regular expression matches, without its look-arounds."""
    out = ""
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "IN":
                out += chr(rng.choice(arg)[1])
            case "ANY":
                out += "x"
            case "MAX_REPEAT":
                out += "".join(some_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], 3))))
            case "BRANCH":
                out += some_match(rng.choice(arg[1]), rng)
            case "SUBPATTERN":
                out += some_match(arg[-1], rng)
            case kind:
                assert kind == "ASSERT", kind
    return out


def test_license_prefilter_loses_nothing():
    for text in ("Creative Commons Zero v1.0 Universal", "CC0 1.0", "a cc0 b"):
        words = f" {b' '.join(licenses.words_of(text)).decode()} "
        assert (got := licenses.scan_words(words))["labels"] == "cc0-1.0" and got["score"] == licenses.MENTION[1], text
    rng = random.Random(6)
    for rule in licenses.rules():
        for _ in range(12):
            words = f" {some_match(re._parser.parse(rule.pattern.pattern), rng)} "
            whole = next((m.span() for m in rule.pattern.finditer(words)), None)
            # Words with signs that words never have match nothing.
            assert whole or re.search(r"[^a-z0-9 ]", words), (rule, words)
            if whole:
                assert any(a <= whole[0] and whole[1] <= b for a, b, *_ in licenses.places(words)), (rule, words)


@pytest.mark.parametrize("make", [corpus, hostile])
def test_packing(spark, make):
    df = make(spark)
    rows = packing.pack(df, open_windows=4, max_gap=16).collect()
    texts = sorted(((r.doc_id, packing.encode(r.text).tobytes()) for r in df.collect()), key=str)
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length > 0
            at += r.length
        assert at <= packing.WINDOW
    total = sum(len(b) // 4 for _, b in texts)
    assert sum(r.length for r in rows) == total
    padded = sum(n if n & (n - 1) == 0 else packing.WINDOW for n in (sum(r.length for r in p) for p in sequences.values()))
    assert padded <= 1.05 * total
    for doc, ids in texts:
        if [d for d, _ in texts].count(doc) == 1:
            pieces = sorted(by_doc[doc], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in pieces) == ids and all(r.doc_tokens == len(ids) // 4 for r in pieces)
    assert packing.pack(df.limit(0)).count() == 0


def test_both_tokenizers_agree_on_a_whole_table():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    assert len(texts) == 1000 and all((packing.encode(t) == packing.encode(t, packing.BPE_JSON)).all() for t in texts)


def test_both_tokenizers_agree():
    rng = random.Random(5)
    pool = ["a", " ", "\n", "é", "ß", "\U0001f600", "9", "'s", "<|endoftext|>", "日本", "́", " ", "don't", "\r\n", "x" * 40, "٣", "‍", "Ǆ"]
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert packing.encode(text).tolist() == packing.encode(text, packing.BPE_JSON).tolist()


def test_targets_fill_to_the_brim():
    sizes = {"a": 1000, "b": 10, "c": 5000, "d": 0, None: 300}
    got = mixing.targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


def test_mixing(spark):
    df = corpus(spark).unionByName(hostile(spark))
    rows = mixing.mix(df).collect()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(SPACE.findall(r.text or ""))
    expected = mixing.targets(sizes, (5, 2, 1), 1.5, 2.0)
    for source, target in expected.items():
        own = [r for r in rows if r._row.source == source]
        assert all(r._target == pytest.approx(target) and r._source_size == sizes[source] and r._copies <= 2 for r in own)
        largest = max(r._size for r in own)
        assert abs(sum(r._size * r._copies for r in own) - target) <= 2 * largest
    assert len(rows) == df.count()
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, rows))
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.take(df).columns == df.columns


CLASHES = "_row _key _id _text _cls _chosen _size _skey _class _bucket _hash _nth _before _copies buckets copies offset target source_size size n cls key g comp component component_id h k x score predicted spans vslot shard slot start length ids sequence_id merge_group".split()


def test_extra_columns_with_clashing_names(spark):
    docs, labels = labelled(spark, 60)
    wide = docs.withColumns({c: F.lit("?") for c in CLASHES})
    assert mixing.take(wide).columns == ngram_join.one_of_each(wide).columns == wide.columns
    assert sorted(r._copies for r in mixing.mix(wide).collect()) == sorted(r._copies for r in mixing.mix(docs).collect())
    assert ngram_join.one_of_each(wide).count() == ngram_join.one_of_each(docs).count()
    for module, kept in ((quality, quality.keep_good), (toxicity, toxicity.drop_toxic)):
        model = module.fit(wide, labels.withColumns({c: F.lit(1) for c in CLASHES}))
        assert module.score_documents(wide, model).count() == 60 and kept(wide, model).columns == wide.columns
    for got in (packing.pack(wide), repetition.score(wide), licenses.scan(wide), media.read_tiles(media.tile_texts(wide)), sharding.assign(wide, sharding.SlotMap.build(3))):
        assert got.count() >= 60


def brute_repeats(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            if i != j:
                k = 0
                while max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def test_suffix_array_repeats():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 10, 60, 120]:
        for letters in (1, 2, 5):
            words = [rng.randrange(letters) for _ in range(n)]
            assert repetition.repeat_lengths(np.array(words, dtype=np.uint64)).tolist() == brute_repeats(words)


def test_suffix_array_memory_does_not_depend_on_repeats():
    peaks = []
    rng = np.random.default_rng(1)
    for words in (rng.integers(0, 1 << 60, 200_000), np.zeros(200_000, np.int64), np.tile(rng.integers(0, 9, 1000), 200)):
        tracemalloc.start()
        start = time.time()
        lengths = repetition.repeat_lengths(words.astype(np.uint64))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert time.time() - start < 20
    # The last: a passage of 1,000 words, 200 times.
    assert lengths[0] == 199_000 and lengths[-1] >= 1 and max(peaks) < 150 * 200_000


def test_common_prefixes_of_long_repeats():
    keys = np.array([1, 2, 3] * 4000 + [9] + [1, 2, 3] * 4000, dtype=np.uint64)
    got = repetition.common_prefixes(keys, np.array([0, 0, 1, 12000, 5]), np.array([12001, 3, 12002, 0, 5]))
    assert got.tolist() == [12000, 11997, 11999, 0, len(keys) - 5]


def brute_rules(text, least=repetition.MIN_REPEAT):
    text = text or ""
    words = SPACE.findall(text)
    n = len(words)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    repeats = brute_repeats(words)
    covered = {p for i, k in enumerate(repeats) if k >= least for p in range(i, i + k)}
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n, len(covered), max(repeats, default=0)


def test_quality_rules(spark):
    line = "alpha beta gamma delta epsilon zeta eta"
    texts = [None, "", "a", f"{line}\n{line}\n\n\n \n{line} ", "x y z " * 12, "é# <b> | é# <b> |", " ".join(f"w{i}" for i in range(70)) + "\n" + " ".join(f"w{i}" for i in range(20))]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for r in repetition.score(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.covered_words, r.longest_repeat)
        assert got == brute_rules(texts[r.doc_id]), texts[r.doc_id]
        assert sum(s.length for s in r.spans) == r.covered_words and not (r.base_failed and r.kept)
    assert repetition.score(hostile(spark)).count() == 11 and repetition.score(df.limit(0)).count() == 0


def test_repeat_limits_as_windows():
    """What the SQL relies on: repeats of k words or more cover the words of k-word windows found twice."""
    rng = random.Random(7)
    for n in (5, 30, 80):
        for letters in (2, 3, 6):
            words = [rng.randrange(letters) for _ in range(n)]
            lengths = repetition.repeat_lengths(np.array(words, dtype=np.uint64))
            for k in (3, 6, 9):
                windows = [tuple(words[i : i + k]) for i in range(n - k + 1)]
                twice = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(k)}
                assert set(np.flatnonzero(repetition.covered(lengths, k)).tolist()) == twice
                assert (lengths.max(initial=0) >= k) == bool(twice)


def with_passage(n_words, size, times):
    """A text of `n_words` words, all different but for a passage of `size` words that it holds `times` times, apart."""
    passage, others = [f"p{i}" for i in range(size)], [f"w{i}" for i in range(n_words - size * times)]
    step = len(others) // times
    return " ".join(itertools.chain(*[passage + others[k * step : (k + 1) * step if k < times - 1 else None] for k in range(times)]))


def test_suffix_array_rules_bind_on_their_own(spark):
    # Covered fraction alone; longest repeat alone; both at their limits; the passage of 300 words in 2,000.
    made = [(200, 10, 4), (1000, 51, 2), (1000, 50, 2), (100, 7, 2), (2000, 300, 3)]
    df = spark.createDataFrame([(i, with_passage(*m), None, None, None) for i, m in enumerate(made)], DOCS)
    got = sorted(repetition.score(df).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.longest_repeat, r.covered_words) for r in got] == [(n, size, size * times) for n, size, times in made]
    assert not any(r.base_failed for r in got) and [r.kept for r in got] == [False, False, True, True, False]
    assert got[0].longest_repeat <= repetition.MAX_LONGEST and got[1].covered_words <= repetition.MAX_COVERED * got[1].n_words


def labelled(spark, n=400):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumf", "zlort"]) + rng.choice(["", "ed", "ing", "s"]))
        docs.append((i, (" ".join(f"{w}###" for w in words) if bad else " ".join(words)) + ".", "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    docs, labels = labelled(spark)
    module = quality if kind == "quality" else toxicity
    model = module.fit(docs, labels)
    scored = module.score_documents(docs, model).withColumn("held_out", module.held_out("doc_id")).join(labels, "doc_id").collect()
    held = [r for r in scored if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r[kind] for r in held) >= 0.95 * len(held)
    assert [r.held_out for r in scored] == [zlib.crc32(str(r.doc_id).encode()) % module.HELD_OUT_OF == module.HELD_OUT for r in scored]
    odd = module.score_documents(hostile(spark), model).collect()
    assert len(odd) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert module.score_documents(docs.limit(0), model).count() == 0
    again = module.fit(docs, labels)
    assert sorted(map(str, module.score_documents(docs, again).collect())) == sorted(map(str, module.score_documents(docs, model).collect()))
    filtered = quality.keep_good(docs, model) if kind == "quality" else toxicity.drop_toxic(docs, model)
    wanted = {r.doc_id for r in scored if r.predicted == (1 if kind == "quality" else 0)}
    assert filtered.columns == docs.columns and {r.doc_id for r in filtered.collect()} == wanted
    module.score_documents(docs, module.fit(docs, labels.limit(0))).count()
    module.score_documents(docs, module.fit(docs, labels.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")))).count()


def test_toxic_spans(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    for r in docs.collect():
        found = {r.text.encode()[s.start : s.start + s.length].decode() for s in got[r.doc_id].spans}
        assert found == set(re.findall(r"\b(?:grumf|zlort)\w*", r.text))


@pytest.mark.parametrize("depth", [1, 2, 3, 32])
def test_marginals_are_brute_force(monkeypatch, depth):
    rng = np.random.default_rng(4)
    lengths = [1, 2, 5, 3]
    e, start, step = rng.normal(size=11), rng.normal(size=2), rng.normal(size=(2, 2))
    bounds = np.array([0, 0, 1, 3, 8, 8, 11, 11])
    monkeypatch.setattr(toxicity, "_DEPTH", depth)
    monkeypatch.setattr(toxicity, "_LANES", 2)
    got, steps, first = toxicity.marginals(e, bounds, start, step)
    at, expected, all_steps, all_first = 0, [], np.zeros((2, 2)), np.zeros(2)
    for n in lengths:
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = np.exp(start[path[0]] + sum(e[at + i] for i in range(n) if path[i]) + sum(step[a, b] for a, b in itertools.pairwise(path)))
        total = sum(weight.values())
        expected += [sum(w for p, w in weight.items() if p[i]) / total for i in range(n)]
        for p, w in weight.items():
            all_first[p[0]] += w / total
            for a, b in itertools.pairwise(p):
                all_steps[a, b] += w / total
        at += n
    assert np.allclose(got, expected) and np.allclose(steps, all_steps) and np.allclose(first, all_first)


def test_equal_texts_get_equal_scores(spark):
    """Whatever texts are beside them, and wherever in a slice they stand."""
    docs, labels = labelled(spark)
    texts = [r.text for r in docs.collect()]
    long = " ".join(texts[:40])
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate([t for _ in range(40) for t in (*rng.sample(texts, rng.randint(0, 30)), long, texts[7], "", None, texts[10])])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for module in (quality, toxicity):
        model = module.fit(docs, labels)
        scores = {}
        for r in module.score_documents(df, model).collect():
            scores.setdefault(rows[r.doc_id][1], set()).add(r.score)
        assert len(scores) > 100 and all(len(found) == 1 for found in scores.values())


@pytest.mark.parametrize("prior", [None, 0.3, 0.9])
def test_risk_and_its_gradient(prior):
    rng = np.random.default_rng(6)
    p, u = rng.normal(0.5, 1, (7, 3)), rng.normal(-0.5, 1, (9, 3))
    seen = set()
    for bias in (-6.0, 0.0, 6.0):
        weights = [rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=4), np.array([bias])]
        value, grads = quality.risk(weights, p, u, prior)
        # The risk by its definition.
        f = lambda x, w: float(np.tanh(x @ w[0] + w[1]) @ w[2] + w[3][0])
        loss = lambda z, sign: np.log1p(np.exp(-sign * z))
        mean = lambda xs, sign, w: sum(loss(f(x, w), sign) for x in xs) / len(xs)

        def by_hand(w):
            if prior is None:
                return mean(p, 1, w) + mean(u, -1, w)
            negative = mean(u, -1, w) - prior * mean(p, -1, w)
            seen.add(bool(negative >= 0))
            return prior * mean(p, 1, w) + negative if negative >= 0 else -negative

        assert value == pytest.approx(by_hand(weights))
        for i, grad in enumerate(grads):
            for at in np.ndindex(grad.shape):
                moved = [[w.copy() for w in weights] for _ in range(2)]
                moved[0][i][at] += 1e-6
                moved[1][i][at] -= 1e-6
                assert grad[at] == pytest.approx((by_hand(moved[0]) - by_hand(moved[1])) / 2e-6, abs=1e-6)
    assert prior is None or (prior < 0.5) in seen


def plain_features(text):
    """The quality features of one text, spelled out."""
    body = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", body)
    n, size = len(words), len(body)
    sets = {"symbol": b"#*$%&|<>^~_=+\\@", "pipe": b"|", "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "stop": b".!?", "mark": b",;:'\"()-[]{}/", "high": bytes(range(128, 256)), "space": b" \t\n\v\f\r", "line": b"\n", "control": bytes([*range(9), 11, 12, *range(14, 32), 127])}
    share = lambda flags: sum(flags) / max(n, 1)
    out = [sum(b in s for b in body) / max(size, 1) for s in sets.values()]
    for name in ("symbol", "digit", "stop", "mark"):
        out += [share(w[-1] in sets[name] for w in words), share(w[0] in sets[name] for w in words)]
    mean = share(map(len, words))
    out += [mean, max(share(len(w) ** 2 for w in words) - mean * mean, 0) ** 0.5, share(len(w) == 1 for w in words), share(len(w) > 20 for w in words)]
    beside = [i > 0 and words[i] == words[i - 1] for i in range(n)]
    distinct, lines = len(set(words)), body.count(b"\n") + 1
    out += [distinct / max(n, 1), share(beside), share(i > 1 and words[i] == words[i - 2] for i in range(n))]
    out += [distinct / max(n, 1) ** 0.5, np.log1p(n), np.log1p(size), np.log1p(n / lines), np.log1p(lines)]
    run = lambda flags: max((len(list(g)) for k, g in itertools.groupby(flags) if k), default=0)
    return out + [np.log1p(run(beside)), np.log1p(run(w[-1] in sets["symbol"] for w in words))]


def test_quality_features_and_scores_are_those_spelled_out():
    rng = random.Random(3)
    pool = ["a", "bc", "É", "x#", "#y", "12", "9.", "end.", "(z)", "w" * 30, "dup", "dup", "|", "\x01"]
    texts = ["", " ", "one", *["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(50)]]
    weights = np.random.default_rng(1)
    k = quality.N_FEATURES
    model = quality.Model(weights.normal(size=k), weights.uniform(0.5, 2, k), weights.normal(size=(k, 4)), weights.normal(size=4), weights.normal(size=4), 0.3, 0.5)
    for _, _, buf, bounds in textkit.slices(pa.array(texts)):
        got = quality.features(buf, bounds)
        expected = np.array([plain_features(t) for t in texts])
        assert np.allclose(got, expected, rtol=1e-5, atol=1e-6)
        logits = np.tanh((got - model.mean) / model.scale @ model.w1 + model.b1) @ model.w2 + model.b2
        assert np.allclose(model.scores(got), 1 / (1 + np.exp(-logits)))


def test_quality_fit_brings_one_row_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 10, f"text number {i} of many", "en", "s", 0) for i in range(3000)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    seen, fit = [], quality.fit_arrays
    monkeypatch.setattr(quality, "fit_arrays", lambda p, u, count: seen.append((len(p), len(u))) or fit(p, u, count))
    quality.fit(docs, labels, max_positive=20, max_unlabelled=20)
    learnable = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(10))
    assert seen == [(learnable, learnable)]
    again = [quality.fit(docs.repartition(n), labels, max_positive=4, max_unlabelled=5) for n in (1, 7)]
    assert seen[1:] == [(4, 5)] * 2 and (again[0].w1 == again[1].w1).all()


def test_class_prior():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(3, 1, 8000), rng.normal(-3, 1, 3000)
    unlabelled = np.concatenate([rng.normal(3, 1, 7000), negative])
    assert abs(quality.class_prior(positive, unlabelled) - 0.7) < 0.06


def test_class_prior_is_that_of_all_unlabelled_rows(spark, monkeypatch):
    docs, labels = labelled(spark)
    seen, whole = [], quality.prior_of_counts
    monkeypatch.setattr(quality, "prior_of_counts", lambda p, cuts, counts: seen.append(counts.sum()) or whole(p, cuts, counts))
    quality.fit(docs, labels, max_unlabelled=50)
    assert seen == [docs.where(~quality.held_out("doc_id")).count()] and seen[0] > 50


def test_slot_maps(spark, tmp_path):
    for n in (1, 2, 5, 16, 17):
        held = np.bincount(sharding.SlotMap.build(n).owners, minlength=n)
        assert held.max() - held.min() <= 1
    old, new = sharding.SlotMap.build(16), sharding.SlotMap.build(16).grown()
    assert new == sharding.SlotMap.build(17) and all(a == b or b == 16 for a, b in zip(old.owners, new.owners, strict=True))
    rng = random.Random(0)
    load = {s: rng.randrange(1, 1000) ** 2 for s in range(sharding.SLOTS)}
    even = old.rebalanced(load)
    total = [sum(load[s] for s, o in enumerate(even.owners) if o == k) for k in range(16)]
    assert max(total) - min(total) <= 0.03 * sum(total) / 16 and even.version == old.version + 1
    path = str(tmp_path / "maps")
    old.save(spark, path)
    even.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == even and sharding.SlotMap.load(spark, path, old.version) == old


def brute_places(rows, owners, grown):
    """Rows by shard, virtual slot, part of it, key (null first), crc32 and size, numbered within their shards."""
    found = []
    for r in rows:
        body = (r.text or "").encode()
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % len(owners)
        crc = zlib.crc32(body)
        found.append((owners[slot], slot, crc % sharding.PARTS, r.doc_id is not None, r.doc_id or 0, crc, len(body) + 1))
    out, next_place = [], {}
    for shard, slot, _, there, key, crc, size in sorted(found):
        out.append((key if there else None, size, crc, "key", shard, next_place.get(shard, 0), grown[slot]))
        next_place[shard] = next_place.get(shard, 0) + 1
    return out


def test_sharding_is_brute_force(spark, monkeypatch):
    # A third of the rows under one id, half of these equal.
    hot = spark.range(90).select(F.lit(3).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    df = corpus(spark).unionByName(hostile(spark)).select("doc_id", "text").unionByName(hot)
    monkeypatch.setattr(sharding, "STEP", 7)
    for n in (1, 4, 16):
        old = sharding.SlotMap.build(n)
        rows = sharding.assign(df, old).collect()
        got = [(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in rows]
        assert sorted(got, key=str) == sorted(brute_places(df.collect(), old.owners, old.grown().owners), key=str)
        sizes = {}
        for r in rows:
            sizes[r.vslot] = sizes.get(r.vslot, 0) + r.size
        assert all(r.slot_bytes == sizes[r.vslot] and r.map_version == old.version for r in rows)
    wide = df.withColumns({c: F.lit("?") for c in ("n", "part", "key", "size", "step", "nth", "vslot", "shard", "before", "within")})
    assert sorted(map(str, sharding.assign(wide, old).collect())) == sorted(map(str, rows))


def test_sharding_of_very_long_texts(spark):
    df = spark.createDataFrame([(1, "é" * 3_000_000), (2, None), (None, "x")], "doc_id long, text string")
    assert sorted((r["size"], r.text_crc32) for r in sharding.assign(df, sharding.SlotMap.build(2)).collect()) == sorted([(6_000_001, zlib.crc32("é".encode() * 3_000_000)), (1, 0), (2, zlib.crc32(b"x"))])


def test_sharding(spark):
    df = corpus(spark).unionByName(hostile(spark))
    rows = sharding.assign(df, sharding.SlotMap.build(4)).collect()
    text = {r.doc_id: r.text for r in df.collect()}
    for shard in range(4):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows) and len(rows) == df.count()
    grown = {(r.doc_id, r.shard) for r in sharding.assign(df, sharding.SlotMap.build(5)).collect()}
    assert {(r.doc_id, r.grown_shard) for r in rows} == grown
    for r in rows:
        if r.doc_id is not None and r.doc_id > 10:
            body = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
    assert sharding.assign(df.limit(0), sharding.SlotMap.build(4)).count() == 0
