"""Toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic. A word's emission comes from hashed features of its spelling: the whole word, its
first 3 to 7 bytes, its last 3 to 5 and its length; so unseen forms of a known stem are tagged, too. Transitions
let toxic words attract each other. Forward-backward gives each word's marginal; a document's score is a logistic
function of its two largest marginals and of its expected number of toxic words; the words with a marginal of at
least `SPAN_AT` are the offending spans.

Labels mark documents, not words, so word labels are derived first: a word, or the beginning of a word, is a toxic
seed if toxic documents hold it so much more often than chance allows that none of all would by luck (a binomial
tail, corrected for their number). For these counts, near copies within the sample count once. Words with a seed
are labelled toxic inside toxic documents and the chain is trained on those sequences.

The fit uses at most `max_documents` labelled documents of at most `max_bytes` each, chosen by a hash of the id;
both bounds are on fitting alone. Scoring reads every text whole, in one pass, without a shuffle. Fits of the same
tables agree bit for bit.

Defined results: null and empty texts, and texts without words, have no toxic words and get the score of none; a
null id counts as empty text when folds are chosen; equal texts get equal scores, whatever texts are beside them,
and so do repeated rows; very long texts are tagged whole, in memory in proportion to them; several labels of one id count
as toxic when their mean is at least 0.5; with no toxic labels or no clean ones nothing is toxic; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import arrow_map, arrow_schema, crc_of_id, fields, give_back_memory, md5_int
from .quality import filter_rows

MAX_DOCUMENTS, MAX_BYTES = 8_000, 1 << 16
HELD_OUT_OF, HELD_OUT = 5, 0
SPAN_AT = 0.5
BITS = 18
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7), (3, 4, 5)
#: Besides whole words, beginnings of so many bytes can be seeds.
STEMS = (4, 5, 6, 7, 8)
_N_FEATURES = 2 + len(PREFIXES) + len(SUFFIXES)
#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
_BREAKS = K.byte_class([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)])


def words_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text = K.LOWER[buf]
    return text, *K.word_bounds(text, bounds, _BREAKS)


def spelling(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x _N_FEATURES numbers below 2**BITS: the word's features, for words in any order."""
    order = np.argsort(starts)
    starts, ends = starts[order], ends[order]
    length = ends - starts
    kinds = [K.word_hashes(text, starts, ends), np.minimum(length, 24).astype(np.uint64)]
    kinds += [K.word_hashes(text, starts, np.minimum(starts + k, ends)) for k in PREFIXES]
    kinds += [K.word_hashes(text, np.maximum(ends - k, starts), ends) for k in SUFFIXES]
    out = np.empty((len(starts), _N_FEATURES), dtype=np.int32)
    for i, kind in enumerate(kinds):
        out[order, i] = (K.mix(kind ^ K.mix(np.array([i + 1], dtype=np.uint64))) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


#: Words of a lane, and lanes whose words are held at once.
_DEPTH, _LANES = 32, 1 << 11


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains laid end to end.

    emission: the toxic state's score less the clean one's, per word; first: the bounds of the chains, which may be
    empty; start and step: log scores of states and of steps between them. Returns each word's probability to be
    toxic, the sum of the probabilities of each kind of step (2 x 2) and of each first state (2).

    Each chain is cut into lanes of _DEPTH words, from its beginning. All lanes advance together: first each lane's
    product of 2 x 2 matrices, then the messages from lane to lane of all chains together, then the messages within
    lanes. So numpy sees long vectors, whatever the chains, and a chain's numbers depend on that chain alone.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), np.zeros(2)
    per_chain = -(-np.diff(first) // _DEPTH)
    chain = np.repeat(np.arange(len(per_chain)), per_chain)
    lanes = len(chain)
    nth = np.arange(lanes) - np.repeat(np.cumsum(per_chain) - per_chain, per_chain)
    begin = first[chain] + nth * _DEPTH
    size = np.minimum(first[chain + 1] - begin, _DEPTH)
    a, b = np.exp(start), np.exp(step)
    within = np.arange(_DEPTH)[:, None]

    def matrices(lo: int, hi: int):
        """Row vector times m[i][j]: the step into a word. A chain's first word forgets what came before; beyond its
        last word nothing changes."""
        inside = within < size[lo:hi]
        with np.errstate(under="ignore"):
            e = np.exp(np.clip(emission[np.minimum(begin[lo:hi] + within, n - 1)], -30, 30))
        new = (within == 0) & (nth[lo:hi] == 0)
        return inside, new, [[np.where(inside, np.where(new, a[j], b[i][j]) * (e if j else 1.0), float(i == j)) for j in (0, 1)] for i in (0, 1)]

    def scaled(*x):
        total = sum(x)
        return [v / total for v in x]

    # Products over each lane, as far as their direction: p[i][j].
    p = np.empty((2, 2, lanes))
    for lo in range(0, lanes, _LANES):
        _, _, m = matrices(lo, min(lo + _LANES, lanes))
        q = [[np.full(m[0][0].shape[1], float(i == j)) for j in (0, 1)] for i in (0, 1)]
        for t in range(_DEPTH):
            q = [[q[i][0] * m[0][j][t] + q[i][1] * m[1][j][t] for j in (0, 1)] for i in (0, 1)]
            total = q[0][0] + q[0][1] + q[1][0] + q[1][1]
            q = [[v / total for v in row] for row in q]
        p[:, :, lo : lo + _LANES] = q
    into, back = np.full((2, lanes), 0.5), np.full((2, lanes), 0.5)
    by_nth = np.argsort(nth, kind="stable")
    rounds = np.split(by_nth, np.cumsum(np.bincount(nth))[:-1])
    for at in rounds[1:]:
        x, y = into[:, at - 1]
        q = p[:, :, at - 1]
        into[:, at] = scaled(x * q[0, 0] + y * q[1, 0], x * q[0, 1] + y * q[1, 1])
    for at in rounds[:0:-1]:
        x, y = back[:, at]
        q = p[:, :, at]
        back[:, at - 1] = scaled(q[0, 0] * x + q[0, 1] * y, q[1, 0] * x + q[1, 1] * y)
    probability, steps, begins = np.empty(n), np.zeros((2, 2)), 0.0
    for lo in range(0, lanes, _LANES):
        hi = min(lo + _LANES, lanes)
        inside, new, m = matrices(lo, hi)
        ahead = np.empty((2, _DEPTH + 1, hi - lo))
        ahead[:, 0] = into[:, lo:hi]
        for t in range(_DEPTH):
            ahead[:, t + 1] = scaled(*[ahead[0, t] * m[0][j][t] + ahead[1, t] * m[1][j][t] for j in (0, 1)])
        behind = np.empty((2, _DEPTH, hi - lo))
        behind[:, -1] = back[:, lo:hi]
        for t in range(_DEPTH - 1, 0, -1):
            behind[:, t - 1] = scaled(*[m[i][0][t] * behind[0, t] + m[i][1][t] * behind[1, t] for i in (0, 1)])
        clean, toxic = ahead[0, 1:] * behind[0], ahead[1, 1:] * behind[1]
        found = toxic / (clean + toxic)
        probability[(begin[lo:hi] + within)[inside]] = found[inside]
        begins += float(found[new].sum())
        pair = [[ahead[i, :-1] * m[i][j] * behind[j] for j in (0, 1)] for i in (0, 1)]
        inner = np.where(inside & ~new, 1.0 / (pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1]), 0.0)
        steps += [[float((pair[i][j] * inner).sum()) for j in (0, 1)] for i in (0, 1)]
    return probability, steps, np.array([(per_chain > 0).sum() - begins, begins])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    start: np.ndarray
    step: np.ndarray
    calibration: np.ndarray

    def emissions(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Spelled out for each distinct word once."""
        _, at, back = np.unique(K.word_hashes(text, starts, ends), return_index=True, return_inverse=True)
        return (self.weights[spelling(text, starts[at], ends[at])].sum(1) + self.bias)[back]

    def tag(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each word's probability; word starts, ends, and words before each row bound."""
        text, starts, ends, first = words_of(buf, bounds)
        if not len(starts):
            return np.zeros(0), starts, ends, first
        probability, _, _ = marginals(self.emissions(text, starts, ends), first, self.start, self.step)
        return probability, starts, ends, first

    def scores(self, probability: np.ndarray, first: np.ndarray) -> np.ndarray:
        # Spelled out, as a product of matrices may round a row differently among other rows.
        z = self.calibration[0] + sum(sign * weight for sign, weight in zip(document_signs(probability, first).T, self.calibration[1:], strict=True))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _fresh(first: np.ndarray, n: int) -> np.ndarray:
    fresh = np.zeros(n, dtype=bool)
    fresh[first[:-1][np.diff(first) > 0]] = True
    return fresh


def document_signs(probability: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: the log odds of the two largest marginals, and the log of the expected number of toxic words.

    Marginals below 1 % don't add up: a long text isn't toxic for being long.
    """
    n_rows = len(first) - 1
    rows = np.repeat(np.arange(n_rows), np.diff(first))
    clipped = np.clip(probability, 1e-4, 1 - 1e-4)
    most, next_most = np.full(n_rows, 1e-4), np.full(n_rows, 1e-4)
    np.maximum.at(most, rows, clipped)
    # Of several equal maxima, one alone is set aside.
    top = np.flatnonzero(clipped == most[rows])
    rest = np.ones(len(clipped), dtype=bool)
    rest[top[np.unique(rows[top], return_index=True)[1]]] = False
    np.maximum.at(next_most, rows[rest], clipped[rest])
    expected = np.bincount(rows, weights=np.where(probability >= 0.01, probability, 0.0), minlength=n_rows)
    return np.column_stack([np.log(most / (1 - most)), np.log(next_most / (1 - next_most)), np.log1p(expected)])


def seeds(in_toxic: np.ndarray, in_all: np.ndarray, chance: float = 0.01) -> np.ndarray:
    """Which units are toxic seeds, from the number of toxic documents and of all documents that hold them.

    Under chance, each document that holds a unit is toxic with the share that toxic documents have of all pairs of
    a unit and a document. A unit is a seed if P(so many or more) is at most chance / number of units.
    """
    share = in_toxic.sum() / max(in_all.sum(), 1)
    out = np.zeros(len(in_all), dtype=bool)
    if not 0 < share < 1:
        return out
    limit = math.log(chance / len(in_all))
    cache: dict[tuple[int, int], bool] = {}
    for i in np.flatnonzero(in_toxic >= np.maximum(2, share * in_all)):
        k, n = int(in_toxic[i]), int(in_all[i])
        if (k, n) not in cache:
            # The tail is at most its first term over (1 - ratio), as terms fall at least by that ratio.
            log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log(1 - share)
            ratio = (n - k) / (k + 1) * share / (1 - share)
            # Most documents that hold a seed are toxic.
            cache[k, n] = 2 * k >= n and ratio < 1 and log - math.log(1 - ratio) <= limit
        out[i] = cache[k, n]
    return out


def _sketches(words: np.ndarray, first: np.ndarray, size: int = 4) -> np.ndarray:
    """Per row: `size` minima of differently mixed hashes of its 5-word shingles (its own number where it has none)."""
    hashes, owner = K.shingle_hashes(words, first, 5)
    out = np.full((len(first) - 1, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(size):
        np.minimum.at(out[:, i], owner, K.mix(hashes ^ K.mix(np.array([i], dtype=np.uint64))))
    return out


def _originals(sketches: np.ndarray) -> np.ndarray:
    """Which rows share no minimum with an earlier one."""
    out = np.ones(len(sketches), dtype=bool)
    for i in range(sketches.shape[1]):
        first = np.unique(sketches[:, i], return_index=True)[1]
        seen = np.ones(len(sketches), dtype=bool)
        seen[first] = False
        out &= ~seen
    return out


def fit_texts(texts: pa.Array, toxic: np.ndarray, rounds: int = 40, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Trains the chain on whole texts and their labels."""
    nothing = Model(np.zeros(1 << BITS, np.float32), -10.0, np.array([0.0, -5.0]), np.zeros((2, 2)), np.array([-5.0, 0.0, 0.0, 0.0]))
    if not len(toxic) or toxic.all() or not toxic.any():
        return nothing
    # Each distinct word gets a number and is spelled out once, however many texts hold it; a token is its number.
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    spelled_all, stems_all, tokens, held_words, held_rows, counts, sketches = [], [], [], [], [], [], []
    for lo, hi, buf, bounds in K.slices(texts):
        text, starts, ends, first = words_of(buf, bounds)
        words = K.word_hashes(text, starts, ends)
        counts.append(np.diff(first))
        sketches.append(_sketches(words, first))
        new, at = np.unique(words, return_index=True)
        at = np.sort(at[~np.isin(new, known, assume_unique=True)])
        whole = words[at]
        spelled_all.append(spelling(text, starts[at], ends[at]))
        stems_all.append([whole, *[K.word_hashes(text, starts[at], np.minimum(starts[at] + k, ends[at])) for k in STEMS]])
        number = np.concatenate([number, np.arange(len(known), len(known) + len(at), dtype=np.int32)])
        known = np.concatenate([known, whole])
        order = np.argsort(known)
        known, number = known[order], number[order]
        tokens.append(number[np.searchsorted(known, words)])
        pairs = np.unique(tokens[-1] * np.int64(hi - lo) + np.repeat(np.arange(hi - lo), counts[-1]))
        held_words.append((pairs // (hi - lo)).astype(np.int32))
        held_rows.append((pairs % (hi - lo) + lo).astype(np.int32))
    if not len(known):
        return nothing
    count, known = np.concatenate(counts), np.arange(len(known))
    spelled_all = np.concatenate(spelled_all)
    stems_all = [np.concatenate(kind) for kind in zip(*stems_all, strict=True)]
    word, row = np.concatenate(tokens), np.repeat(np.arange(len(count), dtype=np.int32), count)
    held_word, held_row = np.concatenate(held_words), np.concatenate(held_rows)
    original = _originals(np.concatenate(sketches))[held_row]
    held_word, held_row = held_word[original], held_row[original]
    del tokens, held_words, held_rows, original
    in_toxic, in_all, unit_of = [], [], []
    while stems_all:
        units, of = np.unique(stems_all.pop(0), return_inverse=True)
        unit = of[held_word]
        total, bad = np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
        # In eight parts, as each part sorts what it counts.
        for part in range(8):
            some = np.flatnonzero(unit % 8 == part)
            pairs = np.unique(unit[some] * np.int64(len(count)) + held_row[some])
            total += np.bincount(pairs // len(count), minlength=len(units))
            bad += np.bincount(pairs // len(count), weights=toxic[pairs % len(count)], minlength=len(units))
        unit_of.append((of + sum(map(len, in_all))).astype(np.int32))
        in_all.append(total)
        in_toxic.append(bad)
    seed_units = seeds(np.concatenate(in_toxic), np.concatenate(in_all))
    is_seed = np.logical_or.reduce([seed_units[of] for of in unit_of])
    del held_word, held_row, unit, of, unit_of
    # All toxic documents, and as many clean words: the first clean documents, in the order of the sample.
    use = toxic | (np.cumsum(np.where(toxic, 0, count)) <= count[toxic].sum())
    pick = use[row]
    word, row, count = word[pick], row[pick], count[use]
    label = (is_seed[word] & toxic[row]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(count)])
    fresh = _fresh(first, len(word))
    w, bias, start, step = np.zeros(1 << BITS), np.array([-2.0]), np.zeros(2), np.zeros((2, 2))
    before = np.concatenate([[0.0], label[:-1]])
    seen_steps = np.array([[((before == i) & (label == j) & ~fresh).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    seen_first = np.array([(label[fresh] == 0).sum(), (label[fresh] == 1).sum()], dtype=float)
    square = [np.zeros_like(x) + 1e-6 for x in (w, bias, start, step)]
    scale = 1.0 / max(label.sum(), 1.0)
    used = np.unique(word)
    for _ in range(rounds):
        emission = (sum(w[kind] for kind in spelled_all.T) + bias[0])[word]
        probability, steps, firsts = marginals(emission, first, start, step)
        error = np.bincount(word, weights=probability - label, minlength=len(known))
        grads = [
            sum(np.bincount(kind, weights=error[used], minlength=len(w)) for kind in spelled_all[used].T) * scale + decay * w,
            np.array([error.sum()]) * scale,
            (firsts - seen_first) * scale + decay * start,
            (steps - seen_steps) * scale + decay * step,
        ]
        for x, s, g in zip((w, bias, start, step), square, grads, strict=True):
            s += g * g
            x -= rate * g / np.sqrt(s)
    trained = Model(w.astype(np.float32), float(bias[0]), start, step, np.zeros(3))
    # Calibrated on all texts of the sample.
    signs = []
    for _, _, buf, bounds in K.slices(texts):
        probability, _, _, first = trained.tag(buf, bounds)
        signs.append(document_signs(probability, first))
    return Model(trained.weights, trained.bias, start, step, _logistic(np.concatenate(signs), toxic.astype(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """A logistic regression with intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
    return beta


def held_out(id_col: str):
    return crc_of_id(id_col) % HELD_OUT_OF == HELD_OUT


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_documents: int = MAX_DOCUMENTS, max_bytes: int = MAX_BYTES) -> Model:
    """Learns from labelled rows outside the held-out fold, at most as many as the bounds say."""
    learn = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(~held_out("k")).groupBy("k").agg((F.avg("y") >= 0.5).alias("y")).where("y is not null")
    chosen = learn.select("k", "y", md5_int(F.lit("toxic"), F.col("k")).alias("h")).orderBy("h", "k").limit(max_documents)
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.octet_length("text") <= max_bytes)
    # Broadcast: at most max_documents ids. An id that several rows share counts once.
    sample = docs.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("h").alias("h"), F.min("y").alias("y"), F.min("text").alias("text")).toArrow()
    sample = sample.sort_by([("h", "ascending"), ("k", "ascending")])
    model = fit_texts(sample["text"], sample["y"].to_numpy().astype(bool))
    del sample
    give_back_memory()
    return model


SCORED = fields("score double, predicted int, n_toxic_words long, spans:start:int,length:int")


def score_documents(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted, n_toxic_words, spans (offending words, in UTF-8 bytes of the text)."""
    out = T.StructType([documents.select(key).schema[0], *SCORED.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            for lo, hi, buf, bounds in K.slices(batch.column(1)):
                probability, starts, ends, first = model.tag(buf, bounds)
                score = model.scores(probability, first)
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                hit = np.flatnonzero(probability >= SPAN_AT)
                for i, r in zip(hit.tolist(), (np.searchsorted(first, hit, side="right") - 1).tolist(), strict=True):
                    spans[r].append({"start": int(starts[i] - bounds[r]), "length": int(ends[i] - starts[i])})
                columns = {"score": score, "predicted": (score >= 0.5).astype(np.int32), "n_toxic_words": [len(s) for s in spans], "spans": spans}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(arrow.field(0).type), *[pa.array(columns[f.name], f.type) for f in list(arrow)[1:]]], schema=arrow)

    return arrow_map(documents.select(key, text), work, out)


def drop_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents whose score is below 0.5."""

    def clean(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        probability, _, _, first = model.tag(buf, bounds)
        return model.scores(probability, first) < 0.5

    return filter_rows(documents, clean, text)
