"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text are described by dense statistics of the whole text. A first
fit tells positives from unlabelled rows; the share of positives among the unlabelled, the class prior, follows
from it as the smallest ratio of tail shares (no negatives are needed). A small network then minimises the
non-negative unbiased risk

    prior * E_P[loss(f, +)] + max(0, E_U[loss(f, -)] - prior * E_P[loss(f, -)])

and scores every document. Labels of 0 are never used in fitting.

The gradient steps use at most `max_positive` labelled and `max_unlabelled` unlabelled rows, one for each id, chosen
by a hash of the id, then the id; only their statistics reach the driver (some 30 numbers a row). The prior is that of all unlabelled rows outside
the held-out fold: the first fit scores them, and 97 counts reach the driver. Scoring reads every text whole, in one
pass, without a shuffle. Fits of the same tables agree bit for bit.

Defined results: null and empty texts are scored by their statistics, all zero; a null id counts as empty text
when folds are chosen, and such rows are scored, but are in no sample; of several texts under one id one is in the
sample, the least by its statistics' bytes; equal texts get equal scores, whatever texts are beside them, and so do repeated rows; very long texts
are described whole, in memory in proportion to them; several labels of one id count as positive when their mean
is at least 0.5; with no positives every score is 0.5 (kept); an empty table gives no rows; extra columns,
`score` and `predicted` too, are ignored by `score_documents` and replaced by nothing in `keep_good`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .frames import arrow_map, arrow_schema, crc_of_id, fields, give_back_memory, md5_int

MAX_POSITIVE, MAX_UNLABELLED = 12_000, 12_000
HELD_OUT_OF, HELD_OUT = 3, 1
_CLASSES = {
    "symbol": K.byte_class(b"#*$%&|<>^~_=+\\@"),
    "pipe": K.byte_class(b"|"),
    "digit": K.byte_class(b"0123456789"),
    "upper": K.byte_class(range(65, 91)),
    "lower": K.byte_class(range(97, 123)),
    "stop": K.byte_class(b".!?"),
    "mark": K.byte_class(b",;:'\"()-[]{}/"),
    "high": K.byte_class(range(128, 256)),
    "space": K.SPACE,
    "line": K.byte_class(b"\n"),
    "control": K.byte_class([*range(9), 11, 12, *range(14, 32), 127]),
}
_FINAL = ("symbol", "digit", "stop", "mark")
N_FEATURES = len(_CLASSES) + 2 * len(_FINAL) + 14


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def features(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """rows x N_FEATURES: shares of byte classes, and how words, their ends and their repeats are distributed."""
    n_rows = len(bounds) - 1
    size = np.diff(bounds)
    per_byte = 1.0 / np.maximum(size, 1)
    starts, ends, first = K.word_bounds(buf, bounds)
    n = np.diff(first)
    per_word = 1.0 / np.maximum(n, 1)
    rows = np.repeat(np.arange(n_rows), n)
    out = [_sums(table[buf], bounds) * per_byte for table in _CLASSES.values()]
    last, head = (buf[ends - 1], buf[starts]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    for name in _FINAL:
        out.append(_sums(_CLASSES[name][last], first) * per_word)
        out.append(_sums(_CLASSES[name][head], first) * per_word)
    length = ends - starts
    mean = _sums(length, first) * per_word
    spread = np.sqrt(np.maximum(_sums(length * length, first) * per_word - mean * mean, 0))
    out += [mean, spread, _sums(length == 1, first) * per_word, _sums(length > 20, first) * per_word]
    words = K.word_hashes(buf, starts, ends) ^ K.mix(rows.astype(np.uint64))
    ranked, at = np.unique(words, return_index=True)
    distinct = np.bincount(rows[at], minlength=n_rows)
    beside = np.zeros(len(words), dtype=np.int64)
    beside[1:] = words[1:] == words[:-1]
    two = np.zeros(len(words), dtype=np.int64)
    two[2:] = words[2:] == words[:-2]
    out += [distinct * per_word, _sums(beside, first) * per_word, _sums(two, first) * per_word]
    # Distinct words grow with less than the length: compare with the root, too.
    out += [distinct / np.sqrt(np.maximum(n, 1)), np.log1p(n), np.log1p(size)]
    lines = _sums(_CLASSES["line"][buf], bounds) + 1
    out += [np.log1p(n / lines), np.log1p(lines)]
    # The rows' stretches of equal neighbours and of words that end in a symbol.
    run = np.zeros(n_rows)
    np.maximum.at(run, rows, _runs(beside.astype(bool), first))
    ended = np.zeros(n_rows)
    np.maximum.at(ended, rows, _runs(_CLASSES["symbol"][last], first))
    out += [np.log1p(run), np.log1p(ended)]
    return np.stack(out, axis=1).astype(np.float32) if n_rows else np.zeros((0, N_FEATURES), np.float32)


def _runs(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags of one row end at each place without a gap; `first` holds the rows' bounds."""
    total = np.cumsum(flags)
    begins = np.zeros(len(flags), dtype=bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    return total - np.maximum.accumulate(np.where(flags, np.where(begins, total - 1, 0), total)) if len(flags) else total


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Spelled out, as a product of matrices may round a row differently among other rows."""
        x = (x - self.mean) / self.scale
        hidden = np.tanh(self.b1 + sum(x[:, [j]] * w for j, w in enumerate(self.w1)))
        return self.b2 + sum(hidden[:, j] * w for j, w in enumerate(self.w2))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x).astype(np.float64), -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05) -> float:
    """The share of positives among the unlabelled: the smallest ratio of the shares above a score.

    Only tails with at least `least` of the positives count; each ratio gets two standard errors on top, so that
    the minimum isn't one of noise.
    """
    cuts = prior_cuts(positive, least)
    return prior_of_counts(positive, cuts, np.bincount(np.searchsorted(cuts, unlabelled, side="right"), minlength=len(cuts) + 1))


def prior_cuts(positive: np.ndarray, least: float = 0.05) -> np.ndarray:
    return np.quantile(positive, np.linspace(0, 1 - least, 96))


def prior_of_counts(positive: np.ndarray, cuts: np.ndarray, counts: np.ndarray) -> float:
    """class_prior, from how many unlabelled scores lie at or above 0, 1, 2, ... of the cuts and no more."""
    p, n = np.sort(positive), counts.sum()
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.cumsum(counts)[:-1] / n
    error = above_u / above_p * np.sqrt(1 / (len(p) * above_p) + 1 / np.maximum(n * above_u, 1))
    return float(np.clip((above_u / above_p + 2 * error).min() - 2 * error.min(), 0.02, 0.98))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(weights: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """What a step goes down on, and its gradient, for a network of one hidden layer.

    Without a prior, the logistic loss of positives against unlabelled rows. With one, the unbiased risk; where its
    negative part falls below 0, which no true risk does, that part alone with its sign turned: a step back.
    """
    x = np.concatenate([p, u])
    h = np.tanh(x @ weights[0] + weights[1])
    z = h @ weights[2] + weights[3]
    zp, zu = z[: len(p)], z[len(p) :]
    # loss(z, +) = log(1 + exp(-z)), loss(z, -) = log(1 + exp(z)); the derivatives below are of the sums.
    positive, negative = np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean()
    up, down, across = -_sigmoid(-zp) / len(p), _sigmoid(zu) / len(u), _sigmoid(zp) / len(p)
    if prior is None:
        value, g = positive + negative, np.concatenate([up, down])
    else:
        negative -= prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            value, g = prior * positive + negative, np.concatenate([prior * up - prior * across, down])
        else:
            value, g = -negative, np.concatenate([prior * across, -down])
    gh = np.outer(g, weights[2]) * (1 - h * h)
    return float(value), [x.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int = 24, epochs: int = 40, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> list[np.ndarray]:
    """Adam on `risk`, with weight decay."""
    rng = np.random.default_rng(seed)
    k = p.shape[1]
    weights = [rng.normal(0, 1 / np.sqrt(k), (k, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, rounds = 0, max(1, max(len(p), len(u)) // batch)
    for epoch in range(epochs):
        for _ in range(rounds):
            _, grads = risk(weights, p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)], prior)
            for i in (0, 2):
                grads[i] += decay * weights[i]
            step += 1
            speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                weights[i] = weights[i] - speed * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return weights


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray, count: Callable[[Callable, np.ndarray], np.ndarray]) -> Model:
    """`count` gives the counts of prior_of_counts over all unlabelled rows, from what scores features and the cuts."""
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    if not len(positive) or not len(unlabelled):
        k = N_FEATURES
        return Model(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = _train(p, u, None, epochs=15)
    logits = lambda x: np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]
    positive_scores = logits(p)
    cuts = prior_cuts(positive_scores)
    prior = prior_of_counts(positive_scores, cuts, count(lambda x: logits(np.clip((x - mean) / scale, -8, 8)), cuts))
    w = _train(p, u, prior)
    return Model(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior)


def _described(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    out = T.StructType([*[df.schema[k] for k in keep], T.StructField("x", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            for lo, hi, buf, bounds in K.slices(batch.column(len(keep))):
                x = pa.array([row.tobytes() for row in features(buf, bounds)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo).cast(arrow.field(i).type) for i in range(len(keep))], x], schema=arrow)

    return arrow_map(df.select(*keep, text), work, out)


def held_out(id_col: str):
    return crc_of_id(id_col) % HELD_OUT_OF == HELD_OUT


def _matrix(rows: DataFrame) -> np.ndarray:
    table = rows.toArrow().sort_by([("h", "ascending"), ("k", "ascending")])
    return np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def count_scores(documents: DataFrame, logits: Callable[[np.ndarray], np.ndarray], cuts: np.ndarray, text: str = "text") -> np.ndarray:
    """How many documents score at or above 0, 1, 2, ... of the cuts and no more; each task gives one row a count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(cuts) + 1, dtype=np.int64)
        for batch in batches:
            for _, _, buf, bounds in K.slices(batch.column(0)):
                counts += np.bincount(np.searchsorted(cuts, logits(features(buf, bounds)), side="right"), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int64()), pa.array(counts, pa.int64())], names=["cut", "n"])

    found = arrow_map(documents.select(text), work, fields("cut long, n long")).groupBy("cut").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(cuts) + 1, dtype=np.int64)
    for r in found:
        counts[r.cut] = r.n
    return counts


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learns from labelled rows outside the held-out fold, at most as many as the bounds say."""
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("text"))
    learn = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(~held_out("k")).groupBy("k").agg(F.avg("y").alias("y")).where("y >= 0.5")
    # Bounded by ids, of which each gives one row, so by rows.
    chosen = learn.select("k", md5_int(F.lit("positive"), F.col("k")).alias("h")).orderBy("h", "k").limit(max_positive)
    unlabelled = docs.where(~held_out("k") & F.col("k").isNotNull()).select("k").distinct()
    some = unlabelled.select("k", md5_int(F.lit("unlabelled"), F.col("k")).alias("h")).orderBy("h", "k").limit(max_unlabelled)
    # Broadcast: at most max_positive or max_unlabelled ids. An id that several rows share counts once.
    one_each = lambda ids: _described(docs.join(F.broadcast(ids), "k"), "h", "k").groupBy("h", "k").agg(F.min("x").alias("x"))
    everyone = docs.where(~held_out("k"))
    model = fit_arrays(*[_matrix(one_each(ids)) for ids in (chosen, some)], lambda logits, cuts: count_scores(everyone, logits, cuts))
    give_back_memory()
    return model


def score_documents(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted."""
    out = T.StructType([documents.select(key).schema[0], *fields("score double, predicted int").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(out)
        for batch in batches:
            for lo, hi, buf, bounds in K.slices(batch.column(1)):
                score = model.scores(features(buf, bounds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(arrow.field(0).type), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], schema=arrow)

    return arrow_map(documents.select(key, text), work, out)


def filter_rows(documents: DataFrame, verdict, text: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, for which verdict(bytes, bounds) is true; one pass, no join."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, bounds in K.slices(batch.column(batch.schema.get_field_index(text))):
                yield batch.slice(lo, hi - lo).filter(pa.array(verdict(buf, bounds)))

    return arrow_map(documents, work, documents.schema)


def keep_good(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents whose score is at least 0.5."""
    return filter_rows(documents, lambda buf, bounds: model.scores(features(buf, bounds)) >= 0.5, text)
