"""Quality rules on repetition, by suffix arrays.

For each text, the suffix array of its words is computed by prefix doubling, then the longest common prefixes (LCP)
of neighbouring suffixes. A maximal repeated substring is an LCP interval; the deepest interval that a suffix
lies in has the larger of the LCPs with its two neighbours as its value, so the union of all repeats of at least
`min_repeat` words is the union of the spans (suffix, that value). The rule limits the fraction of words covered
by that union and the longest repeat.

Words so covered also stand in repeated 3-word windows, so a covered fraction only decides below the base rule's
half. The limits are those of published rules, not fitted to tables: 14 % for repeats of 6 words (Gopher's for
duplicate 6-grams, there of characters) and 50 words (the exact repeat that deduplication of training data cuts,
there of tokens), in texts of any length.

Many texts share one array: a word's identity includes its row, so no repeat ever leaves its text. Memory is that
of one slice (about a megabyte of text) or of the longest text: some 100 bytes a word, whatever repeats.

Defined results: null or empty texts have no words, cover nothing and fail the base rule; texts shorter than
`min_repeat` repeat nothing; ties don't matter, as spans are united; repeated rows get equal results; an empty
table gives no rows; extra columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkit as K
from .frames import arrow_map, arrow_schema, fields

MIN_REPEAT = 6
MAX_COVERED = 0.14
MAX_LONGEST = 50
_SYMBOLS = K.byte_class(b"#*$%&|<>")
_NEWLINE = K.byte_class(b"\n")
_LEAD = np.array([byte & 0xC0 != 0x80 for byte in range(256)])


#: Words compared at once when prefixes are.
_COMPARED = 1 << 18


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """The suffix array: suffixes are ranked by their first 1, 2, 4, ... items, until all ranks differ.

    Only suffixes that still tie are sorted again: a group of tied suffixes owns the ranks from its first one on.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    del ranked
    # One more rank, for the empty suffix.
    rank = np.full(n + 1, -1, dtype=np.int32)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    tied, h = order[~(first & np.append(first[1:], True))], 1
    del order, first
    while len(tied):
        both = rank[tied].astype(np.int64) << 32 | (rank[np.minimum(tied + h, n)] + 1)
        sort = np.argsort(both, kind="stable")
        tied, both = tied[sort], both[sort]
        del sort
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        own = (both >> 32).astype(np.int32)
        del both
        at = np.arange(len(tied), dtype=np.int32)
        begins = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), at, 0))
        rank[tied] = own + np.maximum.accumulate(np.where(fresh, at, 0)) - begins
        h *= 2
        tied = tied[~(fresh & np.append(fresh[1:], True))]
    order = np.empty(n, dtype=np.int32)
    order[rank[:n]] = np.arange(n, dtype=np.int32)
    return order


def common_prefixes(keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of places, how many items from there on are equal; in strides that double while they are."""
    n = len(keys)
    length = np.zeros(len(left), dtype=np.int64)
    going, stride = np.arange(len(left)), 1
    while len(going):
        after = []
        stride = max(1, min(stride, _COMPARED // len(going)))
        for lo in range(0, len(going), max(1, _COMPARED // stride)):
            some = going[lo : lo + max(1, _COMPARED // stride)]
            a, b = left[some] + length[some], right[some] + length[some]
            steps = np.arange(stride)
            differ = keys[np.minimum(a[:, None] + steps, n - 1)] != keys[np.minimum(b[:, None] + steps, n - 1)]
            differ |= np.maximum(a, b)[:, None] + steps >= n
            ended = differ.any(1)
            length[some] += np.where(ended, differ.argmax(1), stride)
            after.append(some[~ended])
        going = np.concatenate(after)
        stride *= 2
    return length


def neighbour_lcp(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each entry's LCP with the entry before it in the suffix array (0 for the first).

    Where the items before a suffix and before its neighbour are equal, the LCP is that of the suffix one place earlier
    less one; so only the others are compared, and their LCPs add up to at most 2 n log n.
    """
    n = len(order)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    own = before <= 0
    own[0] = True
    own |= keys[np.maximum(place - 1, 0)] != keys[np.maximum(before - 1, 0)]
    by_place = np.zeros(n, dtype=np.int64)
    some = np.flatnonzero(own & (before >= 0))
    by_place[some] = common_prefixes(keys, some, before[some])
    last = np.maximum.accumulate(np.where(own, place, 0))
    return (by_place[last] - (place - last))[order]


def repeat_lengths(keys: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and occurs elsewhere too."""
    out = np.zeros(len(keys), dtype=np.int64)
    if len(keys):
        order = suffix_order(keys)
        lcp = neighbour_lcp(keys, order)
        out[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Which positions the repeats of at least `least` items cover."""
    starts = np.flatnonzero(lengths >= least)
    change = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths[starts], -1)
    return np.cumsum(change[:-1]) > 0


def _row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def _repeat_words(words: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Which words stand in a window of `size` words that its text holds twice or more. `words` differ by row."""
    marked = np.zeros(len(words), dtype=bool)
    hashes, owner = K.shingle_hashes(words, first, size)
    whole = np.repeat(np.diff(first) >= size, np.maximum(np.diff(first) - size + 1, (np.diff(first) > 0).astype(int)))
    hashes, owner = hashes[whole], owner[whole]
    if not len(hashes):
        return marked
    # A row's windows come in order: the i-th starts at its i-th word.
    starts = first[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner)
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(hashes), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    for k in range(size):
        marked[starts[order[twice]] + k] = True
    return marked


METRICS = fields(
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, spans:start:int,length:int"
)


def slice_metrics(buf: np.ndarray, bounds: np.ndarray, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> dict[str, list | np.ndarray]:
    """The columns of METRICS for the rows of one slice."""
    n_rows = len(bounds) - 1
    starts, ends, first = K.word_bounds(buf, bounds)
    n_words = np.diff(first)
    rows = np.repeat(np.arange(n_rows), n_words)
    words = K.word_hashes(buf, starts, ends) ^ K.mix(rows.astype(np.uint64))
    line_starts, line_ends, _ = K.word_bounds(buf, bounds, _NEWLINE)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_rows = np.searchsorted(bounds, line_starts, side="right") - 1
    lines = K.word_hashes(buf, line_starts, line_ends)
    order = np.lexsort((lines, line_rows))
    lines, line_rows = lines[order], line_rows[order]
    again = (lines[1:] == lines[:-1]) & (line_rows[1:] == line_rows[:-1])
    dup_lines = np.bincount(line_rows[1:][again], minlength=n_rows)
    repeat_words = _row_sums(_repeat_words(words, first), first)
    lengths = repeat_lengths(words)
    cover = covered(lengths, min_repeat)
    covered_words = _row_sums(cover, first)
    longest = np.zeros(n_rows, dtype=np.int64)
    np.maximum.at(longest, rows, lengths)
    base_failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    # A covered run ends at its row's end, too.
    fresh = np.ones(len(rows) + 1, dtype=bool)
    fresh[1:-1] = rows[1:] != rows[:-1]
    begins = np.flatnonzero(cover & (fresh[:-1] | ~np.append(False, cover)[:-1]))
    stops = np.flatnonzero(cover & (fresh[1:] | ~np.append(cover, False)[1:])) + 1
    spans: list[list[dict]] = [[] for _ in range(n_rows)]
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
        r = int(rows[a])
        spans[r].append({"start": a - int(first[r]), "length": b - a})
    return {
        "n_words": n_words,
        "word_chars": _row_sums(~K.SPACE[buf] & _LEAD[buf], bounds),
        "n_symbols": _row_sums(_SYMBOLS[buf], bounds),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": ~base_failed & (covered_words <= max_covered * n_words) & (longest <= max_longest),
        "covered_words": covered_words,
        "longest_repeat": longest,
        "spans": spans,
    }


def score(df: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """key and METRICS for each row; `spans` are the united repeats, in words."""
    out = T.StructType([df.select(key).schema[0], *METRICS.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            for lo, hi, buf, bounds in K.slices(batch.column(1)):
                got = slice_metrics(buf, bounds, **limits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(arrow.field(0).type), *[pa.array(got[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return arrow_map(df.select(key, text), work, out)
