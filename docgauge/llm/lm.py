"""Language-model scores by stupid backoff over bigrams, counted over all documents and joined back.

Documents are held in slices of about ``slice_bytes`` of text. Every slice explodes its n-grams into a table of n-gram hash and count in
the slice, partitioned by hash; each partition sums the counts of all slices and joins the sums to every slice's n-grams, which
carries the counts elsewhere back to the slice, where they are summed to scores by document. Rows of these tables travel packed, as sorted
arrays of one slice and partition: as single rows they take more than twice the space. An n-gram has one entry per slice, however
often it occurs, so common ones are no burden, and the number of partitions follows the number of words. Each document is scored
with its own counts taken off (it does not vouch for itself):

    S(w | u) = c(u w) / c(u)   if c(u w) > 0,   else   backoff * S(w);      S(w) = c(w) / N   if c(w) > 0,   else   1 / (N + 1)

with c and N over the other documents. N-grams are 64-bit hashes of words (``wordhash``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from docgauge.llm.common import written
from docgauge.llm.wordhash import mixed, word_hashes

_PART = 1 << 20


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _slices(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """``slice, docs, lengths, n_vocabulary, vocabulary, tokens``: documents of a slice and their words as numbers in its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        words: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def whole() -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate(words), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([task << 32 | made]), pa.array([ids], pa.list_(kind)), pa.array([np.concatenate(lengths).tolist()], pa.list_(pa.int64())),
                    pa.array([len(vocabulary)]), pa.array([_packed(vocabulary)], pa.binary()), pa.array([_packed(tokens.astype(np.uint32))], pa.binary()),
                ],
                ["slice", "docs", "lengths", "n_vocabulary", "vocabulary", "tokens"],
            )

        held = 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts, own = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            at = part = 0
            for i, t in enumerate(texts):
                part += len(t or "")
                if part < _PART and i + 1 < len(texts):
                    continue
                found, of = word_hashes(texts[at : i + 1])
                words.append(found)
                lengths.append(np.bincount(of, minlength=i + 1 - at))
                ids += own[at : i + 1]
                held, at, part = held + part, i + 1, 0
                if held >= slice_bytes:
                    yield whole()
                    made, held, ids, words, lengths = made + 1, 0, [], [], []
        if ids:
            yield whole()

    own = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"slice long, docs array<{own}>, lengths array<long>, n_vocabulary long, vocabulary binary, tokens binary"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array(row["lengths"], np.int64)
    return lengths, _unpacked(row["vocabulary"], np.uint64, row["n_vocabulary"]), _unpacked(row["tokens"], np.uint32, lengths.sum()).astype(np.int64)


def _pairs(lengths: np.ndarray, tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring words of one document as numbers, and the document of each."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    same = doc[1:] == doc[:-1]
    return (tokens[:-1] * size + tokens[1:])[same], doc[1:][same]


def _pair_keys(pairs: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    size = max(1, len(vocabulary))
    return mixed(vocabulary[pairs // size] * np.uint64(0x9E3779B97F4A7C15) + vocabulary[pairs % size] + np.uint64(1))


def _keys(lengths: np.ndarray, vocabulary: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and pairs of a slice in order, their counts, and the pairs."""
    pairs, counts = np.unique(_pairs(lengths, tokens, len(vocabulary))[0], return_counts=True)
    keys = np.concatenate((vocabulary, _pair_keys(pairs, vocabulary)))
    counts = np.concatenate((np.bincount(tokens, minlength=len(vocabulary)), counts))
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order].astype(np.uint64), order


def _planes(values: np.ndarray) -> bytes:
    """Packs unsigned numbers byte plane by byte plane, of which the high ones are mostly zero."""
    return _packed(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(blob, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()


def _exploded(slices: DataFrame, bits: int) -> DataFrame:
    """``part, slice, n, keys, counts``: the n-grams of a slice in each hash partition (sorted, as differences) and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, _ = _keys(*_read(row))
                parts = (keys >> np.uint64(64 - bits)).astype(np.int64)
                edges = np.searchsorted(parts, np.arange((1 << bits) + 1)).tolist()
                full = [p for p in range(1 << bits) if edges[p] < edges[p + 1]]
                spans = [slice(edges[p], edges[p + 1]) for p in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int64()), pa.array([row["slice"]] * len(full), pa.int64()), pa.array([s.stop - s.start for s in spans], pa.int64()),
                        pa.array([_planes(np.diff(keys[s], prepend=np.uint64(0))) for s in spans], pa.binary()),
                        pa.array([_planes(counts[s]) for s in spans], pa.binary()),
                    ],
                    ["part", "slice", "n", "keys", "counts"],
                )

    return slices.mapInArrow(run, "part long, slice long, n long, keys binary, counts binary")


def _elsewhere(exploded: DataFrame) -> DataFrame:
    """``slice, part, n, rest``: for the n-grams of each slice and partition, how often they occur in other slices."""

    def run(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_numbers(k.as_py(), n)) for k, n in zip(rows.column("keys"), sizes)])
        counts = np.concatenate([_numbers(c.as_py(), n) for c, n in zip(rows.column("counts"), sizes)])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        totals = np.add.reduceat(counts[order], first)
        rest = np.empty(len(keys), np.uint64)
        rest[order] = np.repeat(totals, np.diff(np.append(first, len(keys))))
        rest -= counts
        ends = np.cumsum(sizes)
        blobs = [_planes(rest[end - n : end]) for end, n in zip(ends, sizes)]
        return pa.table([rows.column("slice"), rows.column("part"), rows.column("n"), pa.array(blobs, pa.binary())], names=["slice", "part", "n", "rest"])

    return exploded.groupBy("part").applyInArrow(run, "slice long, part long, n long, rest binary")


def _scores(row: dict, rest_of_keys: np.ndarray, corpus: int, backoff: float) -> tuple[np.ndarray, ...]:
    """Sum of log scores, words, pairs found elsewhere and words found nowhere else, for each document of a slice."""
    lengths, vocabulary, tokens = _read(row)
    n_docs, size = len(lengths), max(1, len(vocabulary))
    _, counts, order = _keys(lengths, vocabulary, tokens)
    totals = np.empty(len(order), np.int64)
    totals[order] = (counts + rest_of_keys).astype(np.int64)
    words, pair_total = totals[: len(vocabulary)], totals[len(vocabulary) :]
    doc = np.repeat(np.arange(n_docs), lengths)
    # words: counts elsewhere, by document and word
    own, at, count = np.unique(doc * size + tokens, return_inverse=True, return_counts=True)
    word_rest = (words[own % size] - count)[at]
    rest = (corpus - lengths)[doc].astype(np.float64)
    single = np.where(word_rest > 0, np.log(np.maximum(word_rest, 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1))
    # pairs: counts elsewhere, by document and pair
    pairs, of = _pairs(lengths, tokens, len(vocabulary))
    distinct, pair = np.unique(pairs, return_inverse=True)
    own, at, count = np.unique(of * max(1, len(distinct)) + pair, return_inverse=True, return_counts=True)
    pair_rest = (pair_total[own % max(1, len(distinct))] - count)[at] if len(own) else np.zeros(0, np.int64)
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    hit = pair_rest > 0
    score = single.copy()
    score[second] = np.where(hit, np.log(np.maximum(pair_rest, 1)) - np.log(np.maximum(word_rest[second - 1], 1)), np.log(backoff) + single[second])
    sums = np.bincount(doc, score, n_docs).astype(np.float64)
    return sums, lengths, np.bincount(of[hit], minlength=n_docs), np.bincount(doc[word_rest == 0], minlength=n_docs)


def backoff_scores(docs: DataFrame, backoff: float = 0.4, slice_bytes: int = 8_000_000, part_words: int = 250_000) -> DataFrame:
    """``doc_id, log_score, n_words, n_hits, n_unseen`` for every row of ``docs`` (doc_id, text).

    ``log_score``: the sum of the natural logs of S over the words; ``n_hits``: words scored by their pair; ``n_unseen``: words that no other
    row holds. ``part_words``: about how many words of the corpus a hash partition answers for. Null and empty texts have no words and 0. Rows are documents, so a repeated row vouches for its copy. Null ids are
    kept; no rows give no rows; other columns are left out.
    """
    slices = written(_slices(docs, slice_bytes), "lm-slices")
    corpus = slices.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, corpus / part_words))))

    def run(own: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        parts = sorted(zip(*(back.column(c).to_pylist() for c in ("part", "n", "rest"))))
        rest = np.concatenate([np.zeros(0, np.uint64), *[_numbers(blob, n) for _, n, blob in parts]])
        for row in own.to_pylist():
            columns = _scores(row, rest, corpus, backoff)
            ids = pa.array(row["docs"], own.schema.field("docs").type.value_type)
            out.append(pa.table([ids, *[pa.array(c) for c in columns]], names=["doc_id", "log_score", "n_words", "n_hits", "n_unseen"]))
        return pa.concat_tables(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, log_score double, n_words long, n_hits long, n_unseen long"
    return slices.groupBy("slice").cogroup(_elsewhere(_exploded(slices, bits)).groupBy("slice")).applyInArrow(run, schema)
