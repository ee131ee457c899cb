"""Classifiers from positive and unlabelled texts, by the non-negative unbiased risk.

``features`` turns whole texts into style measures and hashed byte n-grams. ``fit`` picks telling n-grams from document
counts, estimates the class prior and minimises

    prior * mean_P loss(+g) + max(0, mean_U loss(-g) - prior * mean_P loss(-g))

for a linear g with logistic loss by Adam; where the second term falls below zero, the step goes against it. Labelled
negatives are not used. The fit sees a bounded sample (``n_positive``, ``n_unlabelled``: the rows with the smallest hashes of their ids);
scores cover every row and the whole of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Byte n-grams: lengths, and bits of the hash space.
GRAMS, SPACE_BITS = (4, 6), 22
_PAD = bytes(max(GRAMS))
_SLICE = 1 << 20


def _classes() -> np.ndarray:
    """A class for each byte: 0 other control, 1 blank, 2 line feed, 3 digit, 4 upper, 5 lower, 6 above ASCII, 7.. marks."""
    kind = np.zeros(256, np.uint8)
    kind[[32, 9]], kind[[10, 13]] = 1, 2
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 3, 4, 5, 6
    for at, marks in enumerate((b".", b",", b"!?", b":;'\"()-", b"#$%&*@^~+=<>{}[]\\/_`", b"|")):
        kind[list(marks)] = 7 + at
    return kind


_CLASS, _N_CLASSES = _classes(), 13
_LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)


def style(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Measures of texts laid one after another, with zero bytes between: shares of byte classes, words, repetition."""
    n_docs, size = len(starts), (ends - starts).astype(np.float64)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(n_docs + 1), np.diff(np.concatenate((starts, [len(data)])), prepend=starts[0])) - 1
    counts = np.bincount(np.maximum(doc, 0) * _N_CLASSES + kind, minlength=n_docs * _N_CLASSES)[: n_docs * _N_CLASSES].reshape(n_docs, _N_CLASSES).astype(np.float64)
    counts[:, 0] = 0
    inside = (kind != 1) & (kind != 2) & (data != 0)
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(data) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
        back = np.cumprod(np.full(len(data) + 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), np.uint64))
        words = (sums[end] - sums[begin]) * back[begin]
    of = doc[begin] if len(begin) else np.zeros(0, np.int64)
    n_words = np.bincount(of, minlength=n_docs).astype(np.float64)
    again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n_docs)
    keyed = np.unique((of.astype(np.uint64) << np.uint64(44)) | (words >> np.uint64(20)))
    distinct = np.bincount((keyed >> np.uint64(44)).astype(np.int64), minlength=n_docs)
    w, s = np.maximum(n_words, 1), np.maximum(size, 1)
    marked = np.bincount(of[np.isin(kind[end - 1], (9, 11, 12))], minlength=n_docs) if len(of) else np.zeros(n_docs)
    capped = np.bincount(of[kind[begin] == 4], minlength=n_docs) if len(of) else np.zeros(n_docs)
    base = np.column_stack(
        [counts[:, 1:] / s[:, None], np.log1p(size), np.log1p(n_words), (n_words > 0) * (size / w), distinct / w, again / w, marked / w, capped / w]
    )
    ratio = np.log(np.maximum(distinct, 1) / w) / np.maximum(np.log1p(n_words), 1)
    loose = counts[:, [9, 11, 12]].sum(1) / s
    return np.column_stack([base, ratio, np.sqrt(loose), np.sqrt(counts[:, 4] / s), np.sqrt(again / w), base[:, 12:14] ** 2, base[:, 14:19] ** 2, n_words == 0])


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each length of n-gram, the hash at every position."""
    low = _LOWER[data].astype(np.uint32)
    for k in GRAMS:
        n = len(low) - k + 1
        h = np.full(n, k, np.uint32)
        for j in range(k):
            h *= np.uint32(0x01000193)
            h ^= low[j : j + n]
        h *= np.uint32(0x9E3779B1)
        yield h >> np.uint32(32 - SPACE_BITS)


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another with zero bytes between, and where each begins and ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + len(_PAD)) - sizes - len(_PAD)
    return np.frombuffer(_PAD.join(texts) + _PAD, np.uint8), starts, starts + sizes


def gram_hits(data: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and columns of the wanted n-grams (``wanted``: column by hash, -1: none) that occur, each pair once."""
    docs, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for found in grams(data) if wanted.max() >= 0 else ():
        column = wanted[found]
        at = np.flatnonzero(column >= 0)
        docs.append(np.searchsorted(starts, at, "right") - 1)
        cols.append(column[at].astype(np.int64))
    pairs = np.unique(np.concatenate(docs) << 16 | np.concatenate(cols))
    return pairs >> 16, pairs & 0xFFFF


def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of a batch in runs of about a megabyte of text."""
    at, held, texts = 0, 0, []
    for i, t in enumerate(batch.column("text")):
        texts.append((t.as_py() or "").encode())
        held += len(texts[-1])
        if held >= _SLICE or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at), texts
            at, held, texts = i + 1, 0, []


@dataclass(frozen=True)
class Model:
    """Weights of the standardised measures and of the n-grams in ``columns`` (column by hash), bias, and the estimated prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    gram_ids: np.ndarray
    gram_weights: np.ndarray
    prior: float

    def wanted(self) -> np.ndarray:
        table = np.full(1 << SPACE_BITS, -1, np.int16)
        table[self.gram_ids] = np.arange(len(self.gram_ids), dtype=np.int16)
        return table

    def scores(self, texts: list[bytes], wanted: np.ndarray) -> np.ndarray:
        data, starts, ends = laid(texts)
        docs, cols = gram_hits(data, starts, wanted)
        g = self.bias + np.bincount(docs, self.gram_weights[cols], len(texts))
        if self.weights.any():
            g += np.clip((style(data, starts, ends) - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def _descend(x, docs, cols, n_grams, is_p, prior, rounds=400, rate=0.05):
    """Adam on the non-negative risk over the whole sample; ``docs``/``cols``: n-gram hits. Returns style weights, n-gram weights, bias."""
    n, k = x.shape
    decay = max(2e-4, 1 / max(1, n))
    theta = np.zeros(k + n_grams + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n_p, n_u = max(1, is_p.sum()), max(1, (~is_p).sum())
    for step in range(1, rounds + 1):
        g = x @ theta[:k] + theta[-1] + np.bincount(docs, theta[k:-1][cols], n)
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        negative = np.logaddexp(0, g)
        rest = negative[~is_p].sum() / n_u - prior * negative[is_p].sum() / n_p
        d_positive = np.where(is_p, prior * (s - 1) / n_p, 0)
        d_rest = np.where(is_p, -prior * s / n_p, s / n_u)
        d = d_positive + d_rest if rest >= 0 else -d_rest
        grad = np.concatenate((x.T @ d, np.bincount(cols, d[docs], n_grams), [d.sum()])) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:k], theta[k:-1], theta[-1]


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in U from scores of held-back P and U: the least ratio of the two top shares, with a margin for small tops.

    Where only positives score high, U's share above a threshold is the prior times P's.
    """
    cuts = np.quantile(p, np.linspace(0.02, 0.98, 97))
    top_p = (p[None] >= cuts[:, None]).mean(1)
    top_u = (u[None] >= cuts[:, None]).mean(1)
    margin = 1.5 * (np.sqrt(0.25 / max(1, len(u))) + np.sqrt(0.25 / max(1, len(p))))
    best = int(np.argmin((top_u + margin) / np.maximum(top_p, 1e-9)))
    return float(np.clip(top_u[best] / max(top_p[best], 1e-9), 0.01, 0.99))


def fit_sample(measures: np.ndarray, docs: np.ndarray, cols: np.ndarray, gram_ids: np.ndarray, is_p: np.ndarray, prior: float | None) -> Model:
    """Fits a model to featurised rows. Too few positives or unlabelled rows to learn from give the score 0.5 to everything."""
    k = measures.shape[1]
    if is_p.sum() < 2 or (~is_p).sum() < 2:
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, gram_ids[:0], np.zeros(0), prior or 0.5)
    u = measures[~is_p]
    mean, scale = u.mean(0), np.maximum(u.std(0), 1e-6)
    x = np.clip((measures - mean) / scale, -8, 8)
    if prior is None:
        fold = np.arange(len(x)) % 2 == 0  # rows come in order of hashes
        part = fold[docs]
        w, gw, b = _descend(x * fold[:, None], docs[part], cols[part], len(gram_ids), is_p, is_p.sum() / len(is_p), 200)
        g = x @ w + b + np.bincount(docs, gw[cols], len(x))
        prior = estimate_prior(g[is_p & ~fold], g[~is_p & ~fold])
    w, gw, b = _descend(x, docs, cols, len(gram_ids), is_p, prior)
    return Model(mean, scale, w, float(b), gram_ids, gw, prior)


def _counted(sample: DataFrame) -> DataFrame:
    """``gram, p, u``: how many positive and unlabelled rows of the sample hold each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                data, starts, _ = laid(texts)
                found = [(np.searchsorted(starts, np.arange(len(h)), "right") - 1) << SPACE_BITS | h for h in grams(data)]
                pairs = np.unique(np.concatenate(found))
                ids, is_p = pairs & ((1 << SPACE_BITS) - 1), part.column("positive").to_numpy(zero_copy_only=False)[pairs >> SPACE_BITS]
                gram, inverse = np.unique(ids, return_inverse=True)
                p = np.bincount(inverse, is_p, len(gram)).astype(np.int64)
                u = np.bincount(inverse, ~is_p, len(gram)).astype(np.int64)
                for at in range(0, len(gram), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 200_000].astype(np.int64)) for c in (gram, p, u)], ["gram", "p", "u"])

    counts = sample.select("positive", "text").mapInArrow(run, "gram long, p long, u long")
    return counts.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _featurised(sample: DataFrame, gram_ids: np.ndarray, styled: bool) -> DataFrame:
    table = np.full(1 << SPACE_BITS, -1, np.int16)
    table[gram_ids] = np.arange(len(gram_ids), dtype=np.int16)
    shared = sample.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                data, starts, ends = laid(texts)
                docs, cols = gram_hits(data, starts, shared.value)
                cut = np.searchsorted(docs, np.arange(len(texts) + 1))
                measures = style(data, starts, ends) if styled else np.zeros((len(texts), 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("at"), part.column("positive"), pa.array(list(measures), pa.list_(pa.float64())),
                        pa.array([cols[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int32())),
                    ],
                    ["at", "positive", "measures", "cols"],
                )

    return sample.select("at", "positive", "text").mapInArrow(run, "at long, positive boolean, measures array<double>, cols array<int>")


def fit(
    docs: DataFrame,
    positives: DataFrame,
    learn: Column,
    styled: bool = True,
    n_grams: int = 4096,
    least_z: float = 5.0,
    n_positive: int = 3000,
    n_unlabelled: int = 6000,
    prior: float | None = None,
) -> Model:
    """A model from ``docs`` (doc_id, text) and the trusted ``positives`` (doc_id), both only where ``learn`` (on doc_id) holds.

    Features are the style measures (if ``styled``) and the at most ``n_grams`` n-grams most over-represented in positives, by
    a log odds ratio of at least ``least_z`` standard errors. Bounds: ``n_positive`` and ``n_unlabelled`` rows reach the fit, so what the driver gathers has a fixed size. ``prior``: share
    of positives among all documents; estimated if not given.
    """
    order = F.xxhash64("doc_id")
    p = positives.where(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(n_positive)
    u = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(n_unlabelled)
    ids = p.withColumn("positive", F.lit(True)).union(u.withColumn("positive", F.lit(False)))
    ids = ids.withColumn("at", F.xxhash64("doc_id", "positive"))
    chosen = [tuple(r) for r in ids.collect()]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, positive boolean, at long")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    n = F.lit(max(1, sum(1 for r in chosen if r[1]))), F.lit(max(1, sum(1 for r in chosen if not r[1])))
    odds = F.log((F.col("p") + 0.5) / n[0]) - F.log((F.col("u") + 0.5) / n[1])
    telling = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    top = _counted(sample).where(telling >= least_z).orderBy(telling.desc(), "gram").limit(n_grams).select("gram").collect() if n_grams else []
    gram_ids = np.sort(np.array([r.gram for r in top], np.int64))
    rows = sorted(_featurised(sample, gram_ids, styled).collect(), key=lambda r: r.at)
    measures = np.array([r.measures for r in rows], np.float64) if rows else np.zeros((0, 1))
    hits = np.array([len(r.cols) for r in rows], np.int64)
    cols = np.array([c for r in rows for c in r.cols], np.int64)
    return fit_sample(measures, np.repeat(np.arange(len(rows)), hits), cols, gram_ids, np.array([r.positive for r in rows], bool), prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with ``text``) and a column ``score``: the probability of the positive class for every row and its whole text.

    Null texts count as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.wanted()))
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wanted = shared.value
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts, wanted))], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
