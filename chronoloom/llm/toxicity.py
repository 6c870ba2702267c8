"""Toxicity scores from positive and unlabelled texts.

A linear model over hashed word features is trained on confirmed toxic texts
and on unlabelled ones with the non-negative risk estimator: with class prior p
and logistic loss l,

    risk = p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g)).

Where the second term falls below zero, the step climbs out of it instead, as
that is where the model would start to fit single unlabelled rows. A word gives
itself and its beginnings as features, so families of words share weight. As the
model is linear, scoring is a sum of one number per word, kept by each worker.

Two models are trained, each on a half of either sample; what they say of the other
halves serves twice. The class prior is the least share of unlabelled texts per
share of positives above any cut of the logits, as far as their numbers prove it.
Then slope and offset of the logits minimise the same risk (with logistic loss and
two parameters it is convex and needs no clamp). The model is the mean of both. No
label but a confirmed positive is used anywhere.

Training reads a bounded sample (about ``positives`` and ``unlabelled`` rows).
Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, kept, small, strings, text_slices, trim

BITS = 18
WORDS = re.compile(r"[^\W_]+")
CACHE_ENTRIES = 250_000
_cache: dict[tuple, dict[str, float]] = kept("toxicity")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, and its beginnings of 2 to 7 characters."""
    raw = [f"={word}", *[f"^{word[:k]}" for k in range(2, min(7, len(word)) + 1)]]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in raw]


Vector = tuple[np.ndarray, np.ndarray]


def text_vector(text: str) -> Vector:
    """Features of a text and their values: counts over the square root of its words, so that noise is alike for any length."""
    counts = Counter(WORDS.findall(text.lower()))
    n = sum(counts.values())
    idx = np.asarray([f for w in counts for f in word_features(w)], dtype=np.int64)
    val = np.asarray([c for w, c in counts.items() for _ in range(1 + max(0, min(7, len(w)) - 1))], dtype=np.float64)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    keys, at = np.unique(idx, return_inverse=True)
    return keys.astype(np.int32), (np.bincount(at, weights=val) / np.sqrt(n)).astype(np.float32)


def _feature_counts(texts: DataFrame, least: int) -> np.ndarray:
    """In how many texts of a bounded sample each feature is, counted by the executors; 0 where in fewer than ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in small(batches):
            found = [text_vector(t)[0] for t in strings(batch.column("text"))]
            k, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["k", "n"])

    rows = texts.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # 2**BITS rows at most
    out = np.zeros(1 << BITS, np.int64)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out


def _collected(texts: DataFrame, among: np.ndarray) -> tuple[list[Vector], list[Vector]]:
    """The vectors of bounded samples on the driver, positives and unlabelled, in an order that does not depend on where they were made.

    ``texts`` tells by ``positive`` and ``sampled`` which a row is in; it may be both.
    ``among`` marks the features that matter; others stay on the executors.
    """
    marks = np.packbits(among).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        wanted = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
        for batch in small(batches):
            got = [(k[ok].tobytes(), v[ok].tobytes()) for k, v in map(text_vector, strings(batch.column("text"))) for ok in [wanted[k]]]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("sampled"), pa.array([k for k, _ in got], pa.binary()), pa.array([v for _, v in got], pa.binary())], names=["positive", "sampled", "k", "v"])

    rows = texts.select("text", "positive", "sampled").mapInArrow(run, "positive boolean, sampled boolean, k binary, v binary").toArrow()
    every = sorted(zip(*[rows.column(c).to_pylist() for c in ("k", "v", "positive", "sampled")]), key=lambda x: x[:2])
    both = [[(np.frombuffer(x[0], np.int32), np.frombuffer(x[1], np.float32)) for x in every if x[which]] for which in (2, 3)]
    return both[0], both[1]


#: A feature speaks for the class if so many positives have it (all, where they are fewer).
LEAST = 3


def _document_counts(vectors: list[Vector]) -> np.ndarray:
    """In how many texts each feature is."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    for k, _ in vectors:
        out[k] += 1
    return out


class _Rows:
    """Sparse rows over the features that ``place`` numbers, each scaled by ``by``; a dot product and its transpose."""

    def __init__(self, vectors: list[Vector], place: np.ndarray, by: np.ndarray):
        self.n = len(vectors)
        cols, vals = [], []
        for k, v in vectors:
            col = place[k]
            ok = col >= 0
            cols.append(col[ok])
            vals.append((v[ok] * by[cols[-1]]).astype(np.float32))
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c in cols])
        self.col, self.val = np.concatenate(cols), np.concatenate(vals)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * g[self.row], minlength=width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of logits of positive and unlabelled texts, and the step's direction by each of them.

    The direction is the risk's gradient; where the risk of the negative class,
    ``mean_U l(-g) - p * mean_P l(-g)``, is below zero, it is that of minus this part.
    """
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up, uu = _sigmoid(zp), _sigmoid(zu)
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    if negative < 0:  # climb back
        return value, prior * up / len(zp), -uu / len(zu)
    return value, -prior * (1 - up) / len(zp) - prior * up / len(zp), uu / len(zu)


def train(p_vec: list[Vector], u_vec: list[Vector], prior: float, steps: int = 200, rate: float = 0.05, decay: float = 1e-4, sure: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights by hashed feature, and the bias. Without positive or unlabelled texts: zeros and the prior's log-odds."""
    prior = min(max(prior, 1e-4), 0.9)
    weights = np.zeros(1 << BITS)
    bias = float(np.log(prior / (1 - prior)))
    if not len(p_vec) or not len(u_vec):
        return weights, bias
    # a feature counts as far as its share among toxic texts surely exceeds, or falls below, that among all
    found = np.flatnonzero(_document_counts(p_vec) >= min(LEAST, len(p_vec)))
    p_df, u_df = _document_counts(p_vec)[found] + 0.5, _document_counts(u_vec)[found] + 0.5
    ratio = np.log(p_df / (len(p_vec) + 1)) - np.log(u_df / (len(u_vec) + 1))
    by = np.sign(ratio) * np.maximum(0, np.abs(ratio) - sure * np.sqrt(1 / p_df + 1 / u_df))
    found, by = found[by != 0], by[by != 0]
    if not len(found):
        return weights, bias
    width = len(found)
    place = np.full(1 << BITS, -1, np.int32)
    place[found] = np.arange(width)
    P, U = _Rows(p_vec, place, by), _Rows(u_vec, place, by)
    w, b = np.zeros(width), bias
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        _, gp, gu = risk(P.dot(w) + b, U.dot(w) + b, prior)
        grad = P.back(gp, width) + U.back(gu, width) + decay * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * fix * m / (np.sqrt(v) + 1e-8)
        b -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    weights[found] = w * by
    return weights, float(b)


def logits(vectors: list[Vector], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.asarray([float(v @ weights[k]) + bias for k, v in vectors])


def class_prior(zp: np.ndarray, zu: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among unlabelled texts, from logits of texts that the model has not seen.

    Above any cut, unlabelled texts are at least the prior times as frequent as
    positives. So the prior is the least such ratio; the cut is the one at which its
    upper bound (both shares off by as much as their numbers allow) is least.
    """
    off_p, off_u = (np.sqrt(np.log(4 / doubt) / 2 / len(z)) for z in (zp, zu))
    cuts = np.sort(zp)
    above_p = 1 - np.arange(len(cuts)) / len(cuts)
    above_u = 1 - np.searchsorted(np.sort(zu), cuts, side="left") / len(zu)
    bound = np.where(above_p > 2 * off_p, (above_u + off_u) / np.maximum(above_p - off_p, 1e-9), np.inf)
    k = int(bound.argmin())
    return float(np.clip(above_u[k] / above_p[k], 1e-4, 0.9))


def calibration(zp: np.ndarray, zu: np.ndarray, prior: float, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn logits of unseen texts into log-odds: least unbiased risk, with a small penalty on the slope.

    With logistic loss it is ``mean_U log(1 + e^f) - p * mean_P f``, convex in both.
    """
    spread = max(1e-9, float(zu.std()))
    u, p = zu / spread, float(zp.mean()) / spread
    a, b = 1.0, 0.0
    for _ in range(steps):  # Newton's method
        s = _sigmoid(a * u + b)
        r = np.maximum(s * (1 - s), 1e-12)
        g = np.asarray([(s * u).mean() - prior * p + 1e-3 * a, s.mean() - prior])
        h = np.asarray([[(r * u * u).mean() + 1e-3, (r * u).mean()], [(r * u).mean(), r.mean() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        step = min(1.0, 2.0 / max(1e-9, abs(da), abs(db)))
        a, b = a - step * da, b - step * db
    return (float(a) / spread, float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


#: The prior before it is known, and the rows of a half that are needed to learn it.
GUESS, ENOUGH = 0.1, 10


def train_calibrated(p_vec: list[Vector], u_vec: list[Vector]) -> tuple[np.ndarray, float]:
    """The mean of two models, each of a half of the rows and calibrated on the others; of few rows, one model as it is."""
    halves = [(p_vec[k::2], u_vec[k::2]) for k in (0, 1)]
    if min(len(x) for half in halves for x in half) < ENOUGH:
        return train(p_vec, u_vec, GUESS)

    def unseen(model: tuple[np.ndarray, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        return logits(halves[1 - k][0], *model), logits(halves[1 - k][1], *model)

    prior = float(np.mean([class_prior(*unseen(train(*halves[k], GUESS), k)) for k in (0, 1)]))
    weights, bias = np.zeros(1 << BITS), 0.0
    for k in (0, 1):
        w, b = train(*halves[k], prior)
        slope, offset = calibration(*unseen((w, b), k), prior)
        weights += w * slope / 2
        bias += (b * slope + offset) / 2
    return weights, bias


def score_texts(texts: list[str], weights: np.ndarray, bias: float, cache: dict[str, float]) -> list[float]:
    out = []
    for part in text_slices(texts):
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for t in part:
            words = WORDS.findall(t.lower())
            z = bias
            if words:
                try:
                    total = sum(map(cache.__getitem__, words))
                except KeyError:
                    for w in set(words):
                        if w not in cache:
                            cache[w] = float(weights[word_features(w)].sum())
                    total = sum(map(cache.__getitem__, words))
                z += total / len(words) ** 0.5
            out.append(float(_sigmoid(np.float64(z))))
    return out


def word_scores(model: tuple) -> dict[str, float]:
    """This worker's scores of words by the model."""
    if model not in _cache:
        _cache.clear()
        _cache[model] = {}
    return _cache[model]


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _chosen(rows: int, of: int, salt: int) -> Column:
    """Chooses about ``rows`` of ``of`` rows by a 64-bit hash of their id; all where there are no more."""
    if of <= rows:
        return F.lit(True)
    return F.coalesce(F.xxhash64(F.lit(salt), F.col("doc_id")) < F.lit(int(rows / of * 2**64) - 2**63), F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 6000) -> tuple[np.ndarray, float]:
    """Train on confirmed toxic documents and on unlabelled ones, none of the held-out fold."""
    spark = docs.sparkSession
    known = labels.where((F.col("toxic") == 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n, total = known.count(), docs.count()
    ids = [(r.doc_id,) for r in known.where(_chosen(positives, n, 1)).collect()]  # about ``positives`` rows
    chosen = F.broadcast(spark.createDataFrame([(*i, True) for i in ids], "doc_id long, positive boolean"))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = _feature_counts(texts.join(chosen, "doc_id", "left_semi"), min(LEAST, max(1, len(ids))))
    sampled = (_chosen(unlabelled, total, 2) & ~held_out(F.col("doc_id"))).alias("sampled")
    rows = texts.join(chosen, "doc_id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"), sampled).where("positive or sampled")
    p, u = _collected(rows, counts > 0)
    if total > unlabelled and not u:
        raise RuntimeError(f"no unlabelled row of {total} is in the sample")
    model = train_calibrated(p, u)
    del p, u, counts
    trim()  # of the driver
    return model


def score(docs: DataFrame, weights: np.ndarray, bias: float, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score and a prediction in the columns ``names``; a null text is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 2**BITS numbers, whatever the input
    key = (zlib.crc32(weights.tobytes()), bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        w, b = shared.value
        cache = word_scores(key)
        for batch in small(batches):
            got = score_texts(strings(batch.column("text")), w, b, cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array([int(x >= 0.5) for x in got], pa.int32())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Every whole text is scored, repeated rows each. Null and empty texts get the
    bias's score. Only ``doc_id`` and ``text`` are read, whatever else there is.
    An empty table gives no row.
    """
    weights, bias = fit(docs, labels)
    kept = docs.select("doc_id", "text")
    return score(kept, weights, bias).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
