"""Quality scores by Bradley-Terry pairwise ranking (operator 6).

Preference pairs (a document labelled 1 is preferred to one labelled 0) teach
weights by logistic loss on feature differences.  A document's score is its
weighted feature sum; the decision threshold is a quantile of the scores of the
documents that taught: by default that of the share of them labelled 0, so that
as many lie above it as are labelled 1.  The reported score is a logistic curve
through the threshold, which lies at ``cut``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, record_batch

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
SHAPES = 512
#: Documented bound: at most so many labelled documents teach (lowest hashes of their ids).
MOST_LABELLED = 20_000

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _classes() -> np.ndarray:
    """A shape code for each code point: lower, upper, digit, space, line end, marks by value, other."""
    table = np.full(0x110000, 5, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 1 if ch.isupper() else 0
        elif ch.isdigit():
            table[c] = 2
        elif ch == "\n":
            table[c] = 4
        elif ch.isspace():
            table[c] = 3
        elif c < 128:
            table[c] = 6 + c % 58
    table[0x3000:0x20000] = 0
    return table


_TABLE: list[np.ndarray] = []


def features(text: str | None) -> np.ndarray:
    """Shape trigram frequencies (hashed) and statistics of a whole text.

    Empty texts have a vector too: all zero but for the first statistic.
    """
    if not _TABLE:
        _TABLE.append(_classes())
    text = text or ""
    out = np.zeros(SHAPES + 12)
    stats = out[SHAPES:]
    words = _WORDS.findall(text)
    if not words:
        stats[0] = 1
        return out
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
    n, m = len(codes), len(words)
    if n > 2:
        grams = codes[:-2] * 4096 + codes[1:-1] * 64 + codes[2:]
        out[:SHAPES] = np.sqrt(np.bincount((grams * 2654435761 >> 7) % SHAPES, minlength=SHAPES) / (n - 2))
    share = np.bincount(codes, minlength=64) / n
    letters = share[0] + share[1]
    lines = text.split("\n")
    counts = Counter(words)
    stats[1] = letters
    stats[2] = share[1] / letters if letters else 0
    stats[3] = share[2]
    stats[4] = share[6:].sum()
    stats[5] = share[5]
    stats[6] = len(counts) / m
    stats[7] = max(counts.values()) / m
    stats[8] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
    stats[9] = len(set(lines)) / len(lines)
    stats[10] = min(n / m, 40) / 40
    stats[11] = np.log1p(m) / 15
    return out


class Ranker:
    """Weights of a Bradley-Terry model and the logistic curve through its threshold."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, cut: float = 0.3) -> None:
        self.mean, self.scale, self.weights, self.threshold, self.cut = mean, scale, weights, threshold, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1, rising with the raw score; ``cut`` at the threshold."""
        z = np.clip(self.raw(x) - self.threshold + np.log(self.cut / (1 - self.cut)), -30, 30)
        return 1 / (1 + np.exp(-z))


def pair_loss(w: np.ndarray, d: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of weights on the feature differences of preference pairs (better less worse), with its gradient."""
    margin = np.clip(d @ w, -30, 30)
    missed = 1 / (1 + np.exp(margin))  # the model's probability that the worse one is preferred
    return float(np.log1p(np.exp(-margin)).mean() + l2 / 2 * (w @ w)), -(missed @ d) / len(d) + l2 * w


def quantile_of(scores: np.ndarray, quantile: float) -> float:
    """A threshold with the share ``quantile`` of the scores below it, halfway to the next one."""
    s = np.sort(scores)
    k = min(max(int(round(quantile * len(s))), 0), len(s))
    if k in (0, len(s)):
        return float(s[0] - 1 if k == 0 else s[-1] + 1)
    return float((s[k - 1] + s[k]) / 2)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, epochs: int = 300, l2: float = 1e-3, seed: int = 11, quantile: float | None = None) -> Ranker:
    """Fit by mini-batch Adam steps on random preference pairs.

    The threshold is the given quantile of the scores of ``x``, or that of the
    share of labels 0.  Without both labels there is no pair: weights are 0
    and every score is the same, above the cut if labels are 1 or absent.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(SHAPES + 12), np.ones(SHAPES + 12))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1] if len(x) else SHAPES + 12)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, w, 1.0 if len(bad) else -1.0)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    z = ((x - mean) / scale).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        at = t * 2000 % pairs
        _, g = pair_loss(w, z[a[at : at + 2000]] - z[b[at : at + 2000]], l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Ranker(mean, scale, w, quantile_of(z @ w, len(bad) / len(x) if quantile is None else quantile))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, label, x) from (doc_id, label, text)."""
    schema = "doc_id bigint, label int, x binary"
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            yield record_batch([(i, y, features(t.as_py()).astype(np.float16).tobytes()) for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)], fields)

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELLED, **parameters) -> Ranker:
    """Learn from the labelled documents that aren't held out.

    ``most`` bounds them: beyond it, those with the lowest hash of their id
    teach.  Rows without a label or an id teach nothing; a label that is
    repeated with different values counts once, by its smallest value, and of
    documents that share an id one teaches, by its smallest features; so at
    most ``most`` rows reach the driver.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``most`` rows of two numbers: small enough for any broadcast
    taught = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "label", "text")
    taught = _feature_rows(taught).groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("row"))
    rows = sorted((r.label, bytes(r.x)) for r in taught.select("row.*").collect())
    x = np.array([np.frombuffer(d, np.float16) for _, d in rows], np.float64).reshape(len(rows), SHAPES + 12)
    return fit_pairs(x, np.array([y for y, _ in rows]), **parameters)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, from its text alone.

    Null texts count as empty, which have a score like any other; repeated rows
    give repeated results; a null id stays null and isn't held out.
    """
    fields, cut = arrow_schema(SCHEMA), ranker.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4 << 20):
            s = ranker.score(np.array([features(t.as_py()) for t in b.column(2)]).reshape(b.num_rows, SHAPES + 12)).tolist()
            yield record_batch([(i, h, v, int(v >= cut)) for i, h, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), s, strict=True)], fields)

    return docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def learn_and_score(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    return score(docs, train(docs, labels, **parameters))
