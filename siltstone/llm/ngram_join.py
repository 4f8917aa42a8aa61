"""N-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its distinct runs of `size` words (of its whole sequence, if it is shorter).
Two documents link when 100 * |A & B| >= percent * |A | B|. The global order of n-grams is cut into fragments;
each set is cut into segments along them, overlaps are counted fragment by fragment and summed per pair.

1. Documents with equal sets form classes; all later work is on classes.
2. Shared n-grams: sets meet in blocks of about a million n-grams, and each n-gram of a block goes to its fragment
   once, with its set's place in the block. A fragment finds which n-grams several blocks hold and returns counts by
   block and place. The sums per document prove most documents to be unlike all others: a link needs `percent` of a
   set to be shared. What remains, copies among it, is counted once more, now with one set of each class.
3. Candidates among the rest, by the rarest n-grams of each set: two sets that link share one within their
   first n - ceil(percent * n) + 1, in the order of document frequency, then hash.
4. Verification of candidates by partial overlaps per fragment, summed per pair.

Groups of near copies have quadratically many links, so links inside known components are not spelled out: first
each list of documents with a common rare n-gram is compared with the member whose n-grams are most common in it
(for near copies that is close to their original). Then, for lists that still hold several components, all pairs
across components are tested, in blocks of at most BLOCK rows, by length and by a bitmap bound that never rejects
a true link. So no link between components is lost, and no list is capped. `all_links=True` spells out every link.

The number of links of a document needs no list of them: all its links are inside its component, whose classes are
dealt into chunks; each pair of chunks is one block, in which overlaps are again counted fragment by fragment and
summed per pair, and which returns one sum per class. Copies count as links.

Words are compared by 64-bit hashes. Texts must be re-readable with the same result, as tables are.

Defined results: null texts, empty texts and texts without words have empty sets, link with nothing and are their
own component; equal sets always link; rows sharing an id are nodes of their own, whose component is found by their
texts; a null id never is a component's id unless all ids there are null; of ties for the most common member of a
list the largest name leads, which no result depends on; a very long text is one set, held by one task at a time and
cut into segments before it is sent; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .components import connected_components
from .frames import arrow_map, arrow_schema, discard, durable, fields, scratch

SIZE, PERCENT = 5, 80
#: N-grams that a fragment of step 2 holds on average at most, and that a block of documents holds at least. A row per
#: block and fragment is no burden while fragments are far fewer than a block's n-grams, that is up to 10**11 or so
#: n-grams; beyond, both numbers should grow with the root of the input.
FRAGMENT_GRAMS, BLOCK_GRAMS = 1_000_000, 1_000_000
MIN_FRAGMENTS = 16
#: Fragments of the order in step 4, as a power of two.
SEGMENT_BITS = 3
#: Rows of one side of a block in the comparison across components.
BLOCK = 1024
#: Classes and n-grams that a chunk of a component holds on average at most when links are counted.
CHUNK_CLASSES, CHUNK_GRAMS = 512, 1_000_000
#: N-grams of one fragment of such a block.
_FRAGMENT = 2048
_BITMAP = 2048


def sets_of_rows(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct hashes by row in unsigned order, row bounds among them), slice by slice."""
    for lo, hi, buf, bounds in K.slices(texts):
        low = K.LOWER[buf]
        starts, ends, first = K.word_bounds(low, bounds)
        yield lo, hi, *K.distinct_by_row(*K.shingle_hashes(K.word_hashes(low, starts, ends), first, size), hi - lo)


def _digests(grams: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set; none for empty sets."""
    view = memoryview(np.ascontiguousarray(grams).view(np.uint8))
    return [hashlib.blake2b(view[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def named_sets(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, n (size of the set), cls (name of the set; null if empty)."""
    out = T.StructType([T.StructField("key", df.schema[key].dataType), *fields("n long, cls binary").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            for lo, hi, grams, at in sets_of_rows(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(arrow.field(0).type), pa.array(np.diff(at)), pa.array(_digests(grams, at), pa.binary())], schema=arrow)

    return arrow_map(df.select(key, text), work, out)


# Step 2


_PIECES = fields("fragment long, block long, names binary, sizes binary, local binary, places binary, grams binary")
_COUNTS = fields("block long, fragment long, names binary, sizes binary, local binary, places binary, shared binary")
#: Sets of one block at most: places in a block are 16-bit numbers, of which the last means several sets.
BLOCK_SETS, _SEVERAL = 1 << 15, 0xFFFF

#: (digests of the sets, None where empty; their n-grams end to end; their bounds among these)
Sets = Iterator[tuple[list[bytes | None], np.ndarray, np.ndarray]]


def fragment_of(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Equal ranges of the order of hashes."""
    return ((grams >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def blocks_of(sets: Sets) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(names, sizes, n-grams) of blocks of distinct sets, of at least BLOCK_GRAMS n-grams but for the last or fullest."""
    held: dict[bytes, int] = {}
    parts: list[np.ndarray] = []
    for digests, grams, at in sets:
        for lo in range(0, len(digests), BLOCK_SETS):
            sizes = np.diff(at[lo : lo + BLOCK_SETS + 1])
            fresh = np.array([d is not None and d not in held and held.setdefault(d, int(n)) > 0 for d, n in zip(digests[lo : lo + BLOCK_SETS], sizes, strict=True)])
            parts.append(grams[at[lo] : at[lo] + sizes.sum()][np.repeat(fresh, sizes)])
            if len(held) >= BLOCK_SETS or sum(map(len, parts)) >= BLOCK_GRAMS:
                yield list(held), np.fromiter(held.values(), np.int64), np.concatenate(parts)
                held, parts = {}, []
    if held:
        yield list(held), np.fromiter(held.values(), np.int64), np.concatenate(parts)


def split_block(sizes: np.ndarray, grams: np.ndarray, fragments: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Per set, how many of its n-grams another set of the block holds; (fragment, places, 32 bits of hashes).

    Each distinct n-gram of the block goes out once, with the place of the one set that holds it, or _SEVERAL. So
    what goes out is six bytes an n-gram, however many fragments there are, and an n-gram of very many sets is one
    entry a block.
    """
    place = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(grams)
    grams, place = grams[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    held = np.diff(np.append(first, len(grams)))
    local = np.bincount(place[np.repeat(held > 1, held)], minlength=len(sizes))
    place, grams = np.where(held > 1, _SEVERAL, place[first]).astype(np.uint16), grams[first]
    cuts = np.flatnonzero(np.diff(fragment_of(grams, fragments), prepend=np.uint64(fragments))).tolist() + [len(grams)]
    numbers = fragment_of(grams[cuts[:-1]], fragments).tolist()
    return local, [(f, place[a:b], grams[a:b].astype(np.uint32)) for f, a, b in zip(numbers, cuts[:-1], cuts[1:], strict=True)]


def _pieces(df: DataFrame, read: Callable[[pa.RecordBatch], Sets], fragments: int) -> DataFrame:
    """One row per block and fragment with n-grams of that block; one of a block's rows, its head, names the block's sets.

    Within a fragment 32 bits of each hash are enough: a collision makes an n-gram look shared, never unshared.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(_PIECES)
        part = TaskContext.get().partitionId()
        for block, (names, sizes, grams) in enumerate(blocks_of(s for batch in batches for s in read(batch))):
            local, split = split_block(sizes, grams, fragments)
            head = (b"".join(names), sizes.astype(np.uint32).tobytes(), local.astype(np.uint32).tobytes())
            rows = [(f, part << 32 | block, *(head if not i else (None,) * 3), places.tobytes(), low.tobytes()) for i, (f, places, low) in enumerate(split)]
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 256], strict=True), arrow, strict=True)], schema=arrow)

    return arrow_map(df, work, _PIECES)


def held_by_others(places: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which entries of a fragment are of one set of their block and are found in another entry, too."""
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice & (places != _SEVERAL)


def _shared_by_fragment(table: pa.Table) -> pa.Table:
    rows = table.select(["places", "grams"]).to_pydict()
    places = [np.frombuffer(x, np.uint16) for x in rows["places"]]
    shared = held_by_others(np.concatenate(places), np.concatenate([np.frombuffer(x, np.uint32) for x in rows["grams"]]))
    found = [np.unique(p[s], return_counts=True) for p, s in zip(places, np.split(shared, np.cumsum([len(p) for p in places])[:-1]), strict=True)]
    arrow = arrow_schema(_COUNTS)
    counted = [pa.array([x[i].astype(kind).tobytes() for x in found], pa.binary()) for i, kind in enumerate((np.uint16, np.uint32))]
    return pa.Table.from_arrays([*[table[c] for c in _COUNTS.fieldNames()[:5]], *counted], schema=arrow)


def sharing_classes(df: DataFrame, read: Callable[[pa.RecordBatch], Sets], percent: int, total: int) -> DataFrame:
    """cls of every set whose n-grams are held by `percent` or more by others: other sets of its block, or any set, its
    own copies too, of other blocks. `total` is the number of n-grams."""
    fragments = max(MIN_FRAGMENTS, -(-total // FRAGMENT_GRAMS))
    out = fields("cls binary")

    def enough(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        head = next(i for i, x in enumerate(rows["names"]) if x)
        names, sizes = rows["names"][head], np.frombuffer(rows["sizes"][head], np.uint32).astype(np.int64)
        shared = np.frombuffer(rows["local"][head], np.uint32).astype(np.int64)
        for places, counts in zip(rows["places"], rows["shared"], strict=True):
            shared[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.uint32)
        kept = np.flatnonzero(100 * shared >= percent * sizes).tolist()
        return pa.Table.from_arrays([pa.array([names[16 * i : 16 * i + 16] for i in kept], pa.binary())], schema=arrow_schema(out))

    counts = _pieces(df, read, fragments).groupBy("fragment").applyInArrow(_shared_by_fragment, _COUNTS)
    return counts.groupBy("block").applyInArrow(enough, out).distinct()


def _sets_of_texts(size: int) -> Callable[[pa.RecordBatch], Sets]:
    return lambda batch: ((_digests(grams, at), grams, at) for _, _, grams, at in sets_of_rows(batch.column(0), size))


def _sets_of_classes(batch: pa.RecordBatch) -> Sets:
    grams = batch.column(1).flatten().flatten().to_numpy().view(np.uint64)
    yield batch.column(0).to_pylist(), grams, np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())])


# Steps 3 and 4


def _segmented(df: DataFrame, text: str, size: int) -> DataFrame:
    """cls, n, segments (hashes as signed longs, by fragment), bitmap."""
    out = T.StructType([*fields("cls binary, n long").fields, T.StructField("segments", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("bitmap", T.BinaryType())])
    parts = np.arange((1 << SEGMENT_BITS) + 1, dtype=np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            for _, _, grams, at in sets_of_rows(batch.column(0), size):
                rows = []
                for name, a, b in zip(_digests(grams, at), at[:-1], at[1:], strict=True):
                    if name:
                        own = grams[a:b]
                        bits = np.zeros(_BITMAP, dtype=np.uint8)
                        bits[(K.mix(own) % np.uint64(_BITMAP)).astype(np.int64)] = 1
                        cuts = np.searchsorted(own >> np.uint64(64 - SEGMENT_BITS), parts)
                        rows.append((name, b - a, np.split(own.view(np.int64), cuts[1:-1]), np.packbits(bits).tobytes()))
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 256], strict=True), arrow, strict=True)], schema=arrow)

    return arrow_map(df.select(text), work, out)


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """g, cls, n, common: each set's rarest n-grams, those that a link can't do without.

    `common` is the mean document frequency of the set's n-grams. N-grams of one set alone come first in the order,
    but are in no list.
    """
    grams = sets.select("cls", "n", F.explode(F.flatten("segments")).alias("g"))
    # Stored, so that adaptive execution can split the join by an n-gram that very many sets hold.
    frequency = durable(grams.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"))
    own = grams.join(frequency, "g").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("shared"), (F.sum("df") / F.first("n")).alias("common"))
    needed = F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (n - size(shared))").cast("int")
    return own.withColumn("prefix", F.slice("shared", F.lit(1), F.greatest(needed, F.lit(0)))).select("cls", "n", "common", F.explode("prefix.g").alias("g"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, overlap, n_a, n_b of the pairs that link. Overlaps are counted fragment by fragment, then summed."""
    segments = sets.select("cls", "n", F.posexplode("segments").alias("fragment", "grams")).where(F.size("grams") > 0)
    left = segments.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("grams_a"))
    right = segments.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("grams_b"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("part"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return total.where(F.col("overlap") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def _near_size(n, m, percent: int):
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the member whose n-grams are the most common."""
    # Stored for the same reason as in `postings`.
    hub = durable(lists.groupBy("g").agg(F.max(F.struct("common", "cls", "n")).alias("hub")))
    return (
        lists.join(hub, "g")
        .where((F.col("cls") != F.col("hub.cls")) & _near_size(F.col("n"), F.col("hub.n"), percent))
        .select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"))
        .distinct()
    )


_SIDES = fields("g long, i int, j int, side int, cls binary, comp binary, n long, bitmap binary")
_PAIR = fields("a binary, b binary")


def block_pairs(g: np.ndarray, side: np.ndarray, cls: np.ndarray, comp: np.ndarray, n: np.ndarray, bitmap: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs (side 0, side 1) of one group, of different components, that may link. Rows are sorted by
    group, then side; `g` numbers the groups.

    |A & B| is at most (|A| + |B| - bits in which the bitmaps differ) / 2.
    """
    left, right = [], []
    at, ahead = np.flatnonzero(side == 0), 1
    while len(at):
        at = at[at + ahead < len(g)]
        at = at[g[at + ahead] == g[at]]
        a = at[side[at + ahead] == 1]
        b = a + ahead
        a, b = (x[(comp[a] != comp[b]) & (cls[a] != cls[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))] for x in (a, b))
        if len(a):
            differ = np.bitwise_count(bitmap[a] ^ bitmap[b]).sum(1, dtype=np.int64)
            most = np.minimum((n[a] + n[b] - differ) // 2, np.minimum(n[a], n[b]))
            may = 100 * most >= percent * (n[a] + n[b] - most)
            left.append(a[may])
            right.append(b[may])
        ahead += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of batches that are sorted by `keys`, in tables that cut no group, and the number of each row's group."""

    def numbers(table: pa.Table) -> np.ndarray:
        columns = [table[k].combine_chunks() for k in keys]
        differs = np.logical_or.reduce([np.asarray(pc.not_equal(c[1:], c[:-1])) for c in columns])
        return np.concatenate([[0], np.cumsum(differs)])

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not len(table):
            continue
        # The last group may go on in the next batch.
        group = numbers(table)
        cut = int(np.searchsorted(group, group[-1]))
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut), group[:cut]
    if rest is not None and len(rest):
        yield rest, np.zeros(len(rest), dtype=np.int64)


def cross_pairs(lists: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """a, b: pairs with a common rare n-gram, of different components, that length and bitmaps don't rule out.

    In each list the members outside the leading member's component are compared with all others. Both sides are
    dealt into chunks of about BLOCK rows, each chunk meets each, and no task holds more than a few of them. Without
    labels every class is a component of its own.
    """
    if labels is None:
        labelled = lists.withColumn("comp", F.col("cls"))
    else:
        labelled = lists.join(labels.select(F.col("node").alias("cls"), F.col("component")), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    by_comp = labelled.groupBy("g", "comp").agg(F.max(F.struct("common", "cls")).alias("top"), F.count("*").alias("rows"))
    led = by_comp.groupBy("g").agg(F.max(F.struct("top", "comp", "rows")).alias("lead"), F.sum("rows").alias("m"))
    # m members in all, o of them outside the leading member's component. Stored for the same reason as in `postings`.
    mixed = labelled.join(durable(led.select("g", F.col("lead.comp").alias("lead"), "m", (F.col("m") - F.col("lead.rows")).alias("o")).where("o > 0")), "g")
    chunks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    deal = lambda c: F.pmod(F.xxhash64("cls"), chunks(c)).cast("int")
    everyone = mixed.select("g", deal("m").alias("i"), F.explode(F.sequence(F.lit(0), chunks("o") - 1)).alias("j"), F.lit(1).alias("side"), "cls", "comp", "n")
    others = mixed.where("comp != lead").select("g", F.explode(F.sequence(F.lit(0), chunks("m") - 1)).alias("i"), deal("o").alias("j"), F.lit(0).alias("side"), "cls", "comp", "n")
    rows = everyone.unionByName(others).join(sets.select("cls", "bitmap"), "cls").select(*_SIDES.fieldNames())
    dealt = rows.repartition(F.col("g"), F.col("i"), F.col("j")).sortWithinPartitions("g", "i", "j", "side")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(_PAIR)
        for table, group in whole_groups(batches, "g", "i", "j"):
            side, n = (table[c].to_numpy() for c in ("side", "n"))
            numbers = [np.unique(np.frombuffer(b"".join(table[c].to_pylist()), "V16").view("u8").reshape(-1, 2), axis=0, return_inverse=True)[1].ravel() for c in ("cls", "comp")]
            bitmap = np.frombuffer(b"".join(table["bitmap"].to_pylist()), np.uint64).reshape(len(n), -1)
            a, b = block_pairs(group, side, *numbers, n, bitmap, percent)
            names = table["cls"].to_pylist()
            pairs = {(min(names[x], names[y]), max(names[x], names[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], schema=arrow)

    return arrow_map(dealt, work, _PAIR).distinct()


def block_degrees(grams: np.ndarray, sizes: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """For each row of a block, the copies of all rows that it links with: rows of `left` against rows of `right`.

    Both hold places of rows; they are the same or have none in common. `grams` holds the rows' n-grams end to end.
    """
    _, at, held = np.unique(grams, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # Only n-grams of several rows overlap; they are numbered anew, in their order.
    several = held > 1
    row, at = row[several[at]], (np.cumsum(several) - 1)[at[several[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    overlap = np.zeros((len(left), len(right)), dtype=np.int64)
    for lo in range(0, int(several.sum()), _FRAGMENT):
        a, b = np.searchsorted(at, [lo, lo + _FRAGMENT])
        has = np.zeros((len(sizes), int(at[b - 1]) + 1 - lo), dtype=np.float32)
        has[row[a:b], at[a:b] - lo] = 1
        overlap += (has[left] @ has[right].T).astype(np.int64)
    links = 100 * overlap >= percent * (sizes[left][:, None] + sizes[right][None, :] - overlap)
    out = np.zeros(len(sizes), dtype=np.int64)
    if np.array_equal(left, right):
        np.fill_diagonal(links, False)
        out[left] = links @ copies[right]
    else:
        out[left], out[right] = links @ copies[right], links.T @ copies[left]
    return out


_BLOCKS = fields("component binary, i int, j int, chunk int, cls binary, copies long")
_DEGREE = fields("cls binary, linked long")


def degrees(sets: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """cls, linked: how many documents of other classes each linked class links with."""
    narrow = durable(labels.withColumnRenamed("node", "cls").join(classes.select("cls", "n", "copies"), "cls"))
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_CLASSES), F.ceil(F.sum("n") / CHUNK_GRAMS)).cast("int")
    dealt = narrow.join(narrow.groupBy("component").agg(chunks.alias("chunks")), "component").withColumn("chunk", F.pmod(F.xxhash64("cls"), "chunks").cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = other.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "cls", "copies")
    rows = blocks.join(sets.select("cls", F.flatten("segments").alias("grams")), "cls").select(*_BLOCKS.fieldNames(), "grams")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(_DEGREE)
        for table, group in whole_groups(batches, "component", "i", "j"):
            i, j, chunk, copies = (table[c].to_numpy() for c in ("i", "j", "chunk", "copies"))
            lists = table["grams"].combine_chunks()
            sizes, grams = np.asarray(pc.list_value_length(lists)).astype(np.int64), lists.flatten().to_numpy()
            ends = np.cumsum(sizes)
            linked = np.zeros(len(group), dtype=np.int64)
            cuts = np.searchsorted(group, np.arange(group[-1] + 2))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                left, right = np.flatnonzero(chunk[a:b] == i[a]), np.flatnonzero(chunk[a:b] == j[a])
                linked[a:b] = block_degrees(grams[ends[a] - sizes[a] : ends[b - 1]], sizes[a:b], copies[a:b], left, right, percent)
            yield pa.RecordBatch.from_arrays([table["cls"].combine_chunks().cast(pa.binary()), pa.array(linked)], schema=arrow)

    return arrow_map(rows, work, _DEGREE).groupBy("cls").agg(F.sum("linked").alias("linked"))


class Join:
    """The join's tables: `members` (key, n, cls), `classes` (cls, n, first_key, copies), `sets` of those classes that
    may link, `links` (a, b, overlap, n_a, n_b) between classes, and `labels` (node, component) of linked classes."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, all_links: bool = False):
        # No other column of `df` goes any further, whatever its name.
        df, key, text = df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text"
        self.percent = percent
        with scratch(df.sparkSession) as keep:
            self.members = keep(durable(named_sets(df, key, text, size)))
            self.classes = keep(durable(self.members.where("cls is not null").groupBy("cls", "n").agg(F.min("key").alias("first_key"), F.count("*").alias("copies"))))
            with scratch(df.sparkSession) as keep_sets:
                self.sets = keep(keep_sets(durable(self._sharing_sets(df, key, text, size))))
            lists = durable(postings(self.sets, percent))
            if all_links:
                self.links = keep(durable(verified(cross_pairs(lists, self.sets, None, percent), self.sets, percent)))
                self._stored_links = (self.links,)
                self.labels = keep(connected_components(self.links))
                return
            star = keep(durable(verified(star_pairs(lists, percent), self.sets, percent)))
            known = connected_components(star)
            across = keep(durable(verified(cross_pairs(lists, self.sets, known, percent), self.sets, percent)))
            self.links, self._stored_links = star.unionByName(across), (star, across)
            self.labels = keep(connected_components(self.links) if across.limit(1).count() else known)

    def _sharing_sets(self, df: DataFrame, key: str, text: str, size: int) -> DataFrame:
        """cls, n, segments, bitmap of the classes that may link."""
        total = lambda rows: rows.agg(F.sum("n")).first()[0] or 0
        copied = durable(sharing_classes(df.select(text), _sets_of_texts(size), self.percent, total(self.members)))
        first = self.classes.join(copied, "cls").select(F.col("first_key").alias("_first_key")).distinct()
        texts = df.join(first, F.col(key).eqNullSafe(F.col("_first_key")), "left_semi")
        # Other texts under the same id aren't asked for; repeated ones count once.
        sets = durable(_segmented(texts, text, size).join(copied, "cls", "left_semi").dropDuplicates(["cls"]))
        sharing = durable(sharing_classes(sets.select("cls", "segments", "n"), _sets_of_classes, self.percent, total(sets)))
        return sets.join(sharing, "cls", "left_semi")

    def documents(self, key: str = "doc_id") -> DataFrame:
        """key, n_shingles, component_id, copies (rows with an equal set), cls, component: one row per document."""
        linked = self.labels.withColumnRenamed("node", "cls").join(self.classes.select("cls", "first_key"), "cls")
        # Stored for the same reason as in `postings`: a component may hold very many classes.
        smallest = durable(linked.groupBy("component").agg(F.min("first_key").alias("component_id")))
        named = linked.join(smallest, "component").select("cls", "component", "component_id")
        # A class without links is its own component. Stored, too, as a class may have very many copies.
        by_class = durable(
            self.classes.join(named, "cls", "left").select(
                "cls", "copies", F.coalesce("component", "cls").alias("component"), F.when(F.col("component").isNull(), F.col("first_key")).otherwise(F.col("component_id")).alias("component_id")
            )
        )
        return self.members.join(by_class, "cls", "left").select(
            F.col("key").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("cls").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
            F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
            "cls",
            "component",
        )

    def with_links(self, key: str = "doc_id") -> DataFrame:
        """`documents` with n_links: how many other documents each links with, copies included."""
        with scratch(self.sets.sparkSession) as keep:
            linked = keep(durable(degrees(self.sets, self.labels, self.classes, self.percent)))
        n_links = F.when(F.col("cls").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("linked", F.lit(0)))
        return self.documents(key).join(linked, "cls", "left").withColumn("n_links", n_links.cast("long")).drop("linked")

    def forget(self) -> None:
        """Deletes `sets` and `links`, which no result of `documents` or `with_links` reads."""
        discard(self.sets, *self._stored_links)


def with_class(df: DataFrame, text: str, size: int, column: str) -> DataFrame:
    """All columns of `df` and the name of each row's set."""
    out = T.StructType([*df.schema.fields, T.StructField(column, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            for lo, hi, grams, at in sets_of_rows(batch.column(batch.schema.get_field_index(text)), size):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)], pa.array(_digests(grams, at), pa.binary())], schema=arrow)

    return arrow_map(df, work, out)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, **options) -> DataFrame:
    """One row of each group of linked documents (one with the smallest id), all rows without words, all columns."""
    with scratch(df.sparkSession) as keep:
        docs = durable(Join(df, key, text, size, **options).documents("_key"))
        chosen = docs.where(F.col("_key").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0))
        chosen = chosen.groupBy("component").agg(F.min(F.struct("_key", "cls")).alias("it")).select("it._key", F.col("it.cls").alias("_cls"))
        chosen = keep(durable(chosen))
        shared_ids = keep(durable(docs.groupBy("_key").agg(F.count("*").alias("rows")).where("rows > 1").select("_key")))
    # The row travels as one struct, so that none of its columns can clash with those added here.
    boxed = df.select(F.struct("*").alias("_row"))
    same = F.col(f"_row.{key}").eqNullSafe(F.col("_key"))
    wordless = boxed.where(~F.coalesce(f"_row.{text}", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    # An id of one row alone is chosen only if that row has words.
    single = boxed.join(chosen.join(shared_ids.withColumnRenamed("_key", "_other"), F.col("_key").eqNullSafe(F.col("_other")), "left_anti"), same, "left_semi")
    found = wordless.unionByName(single)
    if shared_ids.limit(1).count():
        # Where several rows share an id, the row is known by its own set. A join with no such id would move all texts for nothing.
        named = with_class(boxed.join(shared_ids, same, "left_semi").withColumn("_text", F.col(f"_row.{text}")), "_text", size, "_cls")
        picked = chosen.select("_key", F.col("_cls").alias("_chosen"))
        named = named.withColumn("_id", F.col(f"_row.{key}")).join(picked, same & (F.col("_cls") == F.col("_chosen")), "left_semi")
        found = found.unionByName(named.dropDuplicates(["_id", "_cls"]).select("_row"))
    return found.select("_row.*")
