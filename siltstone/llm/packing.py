"""Packing token sequences into fixed windows: bounded-space online best fit.

Each partition is read once. A document's ids are cut into whole windows, which go out at once, and a rest. The
rest goes into the open window that it fills best. When it fits in none and no more windows may be opened, the
fullest goes out; if that one still has a gap of over `max_gap`, the head of the rest fills it first, so padding
stays small. At most `open_windows` windows are held, whatever the partition's size. At the end the partition's
open windows are left over; the leftovers of `merge_partitions` neighbouring partitions meet, are joined end to
end and cut into whole windows, and the last one into sequences whose lengths are powers of two, which need no
padding. So no task ever holds more than open_windows * merge_partitions windows.

Reruns agree as long as the input's partitions hold the same rows in the same order, as scans of tables do; a
lost executor's partition is read again with the same result.

Defined results: a null or empty text is the end token alone; ties go to the window opened first; repeated rows
are packed as often as they come, with equal ids; very long texts give as many whole windows as they need; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, arrow_schema, durable, fields

WINDOW, END_ID = 2048, 1
OPEN_WINDOWS, MERGE_PARTITIONS, MAX_GAP = 64, 16, 32
#: Names for public_tokenizers.path(); their special token's string is read as that token, as `tokenizers` does.
BPE_JSON, BPE_RANKS, BPE_SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
#: Bytes of ids in one output batch.
_FLUSH = 4 << 20


@functools.cache
def _ranks_encoder(name: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=BPE_SPECIAL)


@functools.cache
def _json_encoder(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def encode(text: str | None, tokenizer: str = BPE_RANKS) -> np.ndarray:
    """The document's ids and the end id. A .json file is read by `tokenizers`; a .tiktoken file holds the same
    vocabulary and gives the same ids several times faster."""
    text = text or ""
    if tokenizer.endswith(".json"):
        ids = np.array(_json_encoder(tokenizer).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    else:
        ids = _ranks_encoder(tokenizer).encode_to_numpy(text, allowed_special="all")
    return np.append(ids, END_ID).astype("<u4")


class OpenWindows:
    """At most `most` open windows, found by the gap that they still have."""

    def __init__(self, window: int = WINDOW, most: int = OPEN_WINDOWS, max_gap: int = MAX_GAP):
        self.window, self.most, self.max_gap = window, most, max_gap
        self.gaps: list[tuple[int, int]] = []  # (gap, number), ascending
        self.pieces: dict[int, list] = {}
        self.opened = 0

    def _close(self, at: int) -> list:
        return self.pieces.pop(self.gaps.pop(at)[1])

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        """Places a rest shorter than a window; yields the windows that go out, as lists of pieces."""
        while len(ids):
            at = bisect.bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                gap, number = self.gaps.pop(at)
                self.pieces[number].append((doc, start, ids, total))
                if gap == len(ids):
                    yield self.pieces.pop(number)
                else:
                    bisect.insort(self.gaps, (gap - len(ids), number))
                return
            if len(self.gaps) < self.most:
                self.opened += 1
                self.pieces[self.opened] = [(doc, start, ids, total)]
                bisect.insort(self.gaps, (self.window - len(ids), self.opened))
                return
            gap, number = self.gaps[0]
            if gap > self.max_gap:
                self.pieces[number].append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            yield self._close(0)

    def rest(self) -> list[list]:
        return [self.pieces[number] for _, number in self.gaps]


def cut_to_windows(pieces: list[tuple], window: int = WINDOW) -> Iterator[list[tuple]]:
    """Pieces joined end to end and cut into whole windows, the last part into sequences of 2**k ids."""
    left = sum(len(p[2]) for p in pieces)
    room, current = 0, []
    for doc, start, ids, total in pieces:
        while len(ids):
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
            n = min(room, len(ids))
            current.append((doc, start, ids[:n], total))
            start, ids, room, left = start + n, ids[n:], room - n, left - n
            if not room:
                yield current
                current = []


def _schema(key: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("doc_id", key.dataType), *fields("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, merge_group long").fields])


class _Rows:
    """Collects result rows and turns them into batches."""

    def __init__(self, schema: T.StructType):
        self.arrow = arrow_schema(schema)
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, pieces: list[tuple], sequence: int, group: int | None = None) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset, group))
            offset += len(ids)
        self.size += 4 * offset

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.arrow, strict=True)], schema=self.arrow)
        self.rows, self.size = [], 0


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = BPE_RANKS, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP, merge_partitions: int = MERGE_PARTITIONS) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    schema = _schema(df.select(key).schema[0])

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence = TaskContext.get().partitionId(), 0
        held, out = OpenWindows(window, open_windows, max_gap), _Rows(schema)
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = encode(value.as_py(), tokenizer), doc.as_py()
                whole = len(ids) - len(ids) % window
                for at in range(0, whole, window):
                    out.add([(doc, at, ids[at : at + window], len(ids))], part << 32 | sequence)
                    sequence += 1
                for pieces in held.add(doc, whole, ids[whole:].copy(), len(ids)):
                    out.add(pieces, part << 32 | sequence)
                    sequence += 1
                if out.size > _FLUSH:
                    yield from out.flush()
        for pieces in held.rest():
            out.add(pieces, part << 32 | sequence, part // merge_partitions)
            sequence += 1
        yield from out.flush()

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        out = _Rows(schema)
        pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in rows]
        for n, cut in enumerate(cut_to_windows(pieces, window)):
            out.add(cut, (1 << 30 | rows[0]["merge_group"]) << 32 | n)
        return pa.Table.from_batches(out.flush(), schema=out.arrow)

    placed = durable(arrow_map(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), online, schema))
    merged = placed.where(F.col("merge_group").isNotNull()).groupBy("merge_group").applyInArrow(merge, schema)
    return placed.where(F.col("merge_group").isNull()).unionByName(merged).drop("merge_group")
