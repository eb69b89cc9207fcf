"""Quality scores by positive-unlabelled learning (operator 2).

A linear model over shares of hashed byte n-grams and a few shape measures
minimises the non-negative unbiased risk

    prior * E_pos[l(g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with logistic loss: trusted positives stand for their class, unlabelled text
for the mixture, and no negative is trusted or used. The class prior is estimated
from positives and unlabelled text: a first fit on half of the sample scores the
other half, and the prior is the largest one that the tails of these scores allow.
The fit takes a bounded sample (``Fit.positives`` and ``Fit.unlabelled`` rows,
the smallest by a hash of the id); its features are computed in tasks and are
the only thing that reaches the driver. All rows are scored, whole texts.

Null and empty texts have zero shares and get the score of that vector. With
no positive training row the prior is 0.5 and every score 0.5. Repeated rows
get a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.flat import SPACE, Words, blocks, over_texts, per_row, row_sums

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
GRAMS = {2: 9, 4: 9}  # byte n-gram length: bits of its hash
SIZES = [1 << b for b in GRAMS.values()]
SMOOTH = 20  # added to the count of n-grams, so that shares of short texts stay moderate
SYMBOLS = [ord(c) for c in "#*$%&|<>!?.,;:\"'()[]{}_=/\\@-"]


@dataclass(frozen=True)
class Fit:
    """Bounds of the training sample, and the optimiser's settings."""

    positives: int = 5000
    unlabelled: int = 7000
    steps: int = 400
    rate: float = 0.05
    decay: float = 1.5e-4
    back: float = 1.0  # weight of the step back when the negative part of the risk is below zero
    threshold: float = 0.3


def _kinds() -> np.ndarray:
    """Groups of bytes whose shares are features: one for each symbol, and upper, lower, digit, space, newline, non-ASCII."""
    out = np.zeros(256, np.int64)
    for k, c in enumerate(SYMBOLS, 1):
        out[c] = k
    k = len(SYMBOLS)
    out[65:91], out[97:123], out[48:58], out[32], out[10], out[128:] = k + 1, k + 2, k + 3, k + 4, k + 5, k + 6
    return out


KIND = _kinds()
N_KINDS = len(SYMBOLS) + 7
N_SHAPES = N_KINDS + 8


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape measures of each row of a block."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(rows * N_KINDS + KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS) / size[:, None]
    words = Words(data, offsets)
    count = np.maximum(words.counts, 1)
    keys = np.unique(per_row(words.hashes[0], words.rows), return_index=True)[1]
    kinds = np.bincount(words.rows[keys], minlength=n) / count
    upper = (data >= 65) & (data <= 90)
    firsts = np.bincount(words.rows[upper[words.starts]], minlength=n) / count
    marked = np.isin(data[words.ends - 1], [ord(c) for c in "#*$%&|<>!"]) if len(words) else np.zeros(0, bool)
    ends = np.bincount(words.rows[marked], minlength=n) / count
    length = row_sums(~SPACE[data], offsets) / count
    windows, h = words.windows(4)
    distinct = np.unique(per_row(h, words.rows[windows]), return_index=True)[1]
    again = 1 - np.bincount(words.rows[windows[distinct]], minlength=n) / np.maximum(words.counts - 3, 1)
    again[words.counts < 4] = 0
    same = (words.hashes[0][1:] == words.hashes[0][:-1]) & (words.rows[1:] == words.rows[:-1])
    stutter = np.bincount(words.rows[1:][same], minlength=n) / count
    return np.column_stack([shares, np.log1p(words.counts) / 10, kinds, firsts, ends, length / 20, again, stutter, np.minimum(stutter * 10, 1)])


def gram_codes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n-gram at each byte; n-grams that leave the row are cut by the callers."""
    code = np.zeros(max(len(data) - n + 1, 0), np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) + data[k : k + len(code)]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of hashed n-grams and shape measures, a row each."""
    n, parts = len(offsets) - 1, []
    for length, bits in GRAMS.items():
        codes = gram_codes(data, length, bits)
        grams = np.maximum(np.diff(offsets) - length + 1, 0)
        rows = np.repeat(np.arange(n), grams)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(grams) - grams, grams) + offsets[:-1][rows]
        hits = np.bincount(rows << bits | codes[at], minlength=n << bits).reshape(n, 1 << bits)
        parts.append(hits / (grams + SMOOTH)[:, None])
    return np.column_stack([*parts, shapes(data, offsets)]).astype(np.float32)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


@dataclass(frozen=True)
class Model:
    """Weights over the shares of n-grams, then over the standardised and clipped shape measures, and the bias."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, features: np.ndarray) -> np.ndarray:
        """Scores of feature rows before the logistic function."""
        k = sum(SIZES)
        return self.bias + features[:, :k] @ self.weights[:k] + _standard(features[:, k:], self.mean, self.scale) @ self.weights[k:]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The same sums as ``features @ weights``, by adding a weight for each byte."""
        total, at = np.full(len(offsets) - 1, self.bias), 0
        for length, bits in GRAMS.items():
            w = self.weights[at : at + (1 << bits)]
            at += 1 << bits
            sums = np.concatenate(([0.0], np.cumsum(w[gram_codes(data, length, bits)])))
            grams = np.maximum(np.diff(offsets) - length + 1, 0)
            lo = np.minimum(offsets[:-1], len(sums) - 1)
            total += (sums[np.minimum(lo + grams, len(sums) - 1)] - sums[lo]) / (grams + SMOOTH)
        return 1 / (1 + np.exp(-np.clip(total + _standard(shapes(data, offsets), self.mean, self.scale) @ self.weights[at:], -40, 40)))


def nonnegative_risk_fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, fit: Fit) -> Model:
    """Minimise the non-negative risk with Adam on standardised features."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale > 1e-9, scale, np.inf) + 1e-4
    p, u = (_standard(x, mean, scale).astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1] + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    decay = fit.decay * len(w) ** 0.5 * fit.positives / len(positive)  # small samples are held tighter

    for step in range(1, fit.steps + 1):
        _, negative, grad_positive, grad_negative = risk_gradient(w, p, u, prior)
        grad = grad_positive + grad_negative if negative >= 0 else -fit.back * grad_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= (fit.rate * 0.5 ** (step * 4 / fit.steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    k = sum(SIZES)
    raw = w[:-1].astype(np.float64)
    raw[:k] /= scale[:k]
    return Model(raw, float(w[-1] - (raw[:k] * mean[:k]).sum()), mean[k:], scale[k:])


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Positive and negative part of the risk under the logistic loss, and their gradients; ``w`` ends with the intercept."""

    def part(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope @ x, slope.sum()) / np.float32(len(x))

    gp, gu = (np.clip((x @ w[:-1] + w[-1]).astype(np.float64), -30, 30) for x in (p, u))
    sp, su = ((1 / (1 + np.exp(-g))).astype(np.float32) for g in (gp, gu))
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    return positive, negative, prior * part(p, sp - 1), part(u, su) - prior * part(p, sp)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05) -> float:
    """Largest share of positives among the unlabelled that their scores allow, from held-apart scores of both.

    Unlabelled rows are a mixture, so in any tail of scores they are at least prior times as frequent
    as positives; the prior is at most the smallest ratio of tails, over tails with ``least``
    of the positives or more. Tails shrink to where negatives are rare, which makes the bound tight.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.arange(0, 1 - least + 1e-9, 0.01))
    tail = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    p, u = tail(positive), tail(unlabelled)
    noise = np.sqrt(u * (1 - u) / len(unlabelled)) + u / p * np.sqrt(p * (1 - p) / len(positive))
    best = np.argmin((u + noise) / p)  # small tails vary: the tail is chosen by its ratio one deviation up
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, fit: Fit) -> float:
    """``class_prior`` of the second half of the sample under a first fit on the other half."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    first = nonnegative_risk_fit(positive[::2], unlabelled[::2], 0.5, fit)
    return class_prior(first.raw(positive[1::2]), first.raw(unlabelled[1::2]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of at most ``most`` rows: those with the smallest hash of the id."""
    picked = ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.join(F.broadcast(picked), "doc_id", "left_semi")  # most rows at most

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [f.tobytes() for _, _, data, offsets in blocks(batch.column("text"), 1 << 18) for f in features(data, offsets)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "features": pa.array(rows, pa.binary())})

    rows = over_texts(texts, "doc_id bigint, features binary", work).orderBy("doc_id").toPandas()
    found = [np.frombuffer(x, np.float32) for x in rows["features"]]
    return np.array(found) if found else np.zeros((0, sum(SIZES) + N_SHAPES), np.float32)


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fit on labelled and unlabelled rows outside the held-out fifth."""
    trusted = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    positive = _sample(docs, trusted, fit.positives)
    unlabelled = _sample(docs, docs.where(~held_out(F.col("doc_id"))), fit.unlabelled)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(sum(SIZES) + N_SHAPES), 0.0, np.zeros(N_SHAPES), np.ones(N_SHAPES))
    return nonnegative_risk_fit(positive, unlabelled, estimated_prior(positive, unlabelled, fit), fit)


def quality_scores(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Score of every row of ``docs`` (``doc_id``, ``text``); ``labels`` has doc_id, quality."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fit))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.scores(data, offsets) for _, _, data, offsets in blocks(batch.column("text"))]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "score": pa.array(np.concatenate(found), pa.float64())})

    scored = over_texts(docs, "doc_id bigint, score double", work)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= fit.threshold).cast("int").alias("predicted"))
