"""SimHash near-duplicates, linked through Golay-decoded fingerprint segments.

A fingerprint of 64 bits is cut into four segments of 16. Two fingerprints that differ in at most 3 bits agree in one segment,
and of any two other segments at least one differs in at most 1 bit (3 errors cannot put 2 into both). So one side of a pair
writes, for each segment i and two others j, the key (i, segment i, codeword nearest to segment j); the other side writes
the same with every codeword within 4 of its segment j, which holds the first side's: nearest codewords are within 3 (the
Golay code of 23 bits is perfect), plus the 1 bit of difference. Segments are padded to 23 bits. A join on the key and a bit
count verify.

A key with more than ``crowd`` fingerprints on its first side would pair all within a crowd. Its fingerprints link exactly
through points in between instead: at most 3 apart means a point within 1 of one and 2 of the other, and all around
one point are tied to one member each, so the rows grow with the crowd and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docgauge.llm.common import grown, written
from docgauge.llm.graph import components

_GOLAY = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1, which generates the code
_OTHERS = {0: (1, 2), 1: (2, 3), 2: (3, 0), 3: (0, 1)}


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``width`` words, A-Z in lower case, joined by single spaces; all words if there are fewer."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    last = width - 1
    return [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - last].tolist(), (ends[last:] - 1).tolist())]


def fold(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes lie one after another: a bit is 1 if set in over half of a document's hashes."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        n = lengths[full]
        starts = (np.cumsum(lengths) - lengths)[full]
        wide = int(n.max()) >= 1 << 16  # else four counts fit into one number
        for k in range(64 if wide else 16):
            mask = np.uint64(1 if wide else 0x0001000100010001)
            sums = np.add.reduceat((hashes >> np.uint64(k)) & mask, starts)
            for f in range(1 if wide else 4):
                counts = sums if wide else (sums >> np.uint64(16 * f)) & np.uint64(0xFFFF)
                out[full] |= (counts.astype(np.int64) * 2 > n).astype(np.uint64) << np.uint64(k + 16 * f)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every document as a signed long; texts without words have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                prints = []
                held: list[int] = []
                lengths: list[int] = []
                for text in part.column("text"):
                    found = shingle_hashes(text.as_py(), width)
                    held += found
                    lengths.append(len(found))
                    if len(held) > 500_000:
                        prints.append(fold(np.array(held, np.uint64), np.array(lengths)))
                        held, lengths = [], []
                prints.append(fold(np.array(held, np.uint64), np.array(lengths, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.concatenate(prints).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache
def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of weight up to 4 (the one of weight up to 3 first), and how many there are."""
    errors = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(23), w)], np.uint32)
    syndromes = _syndrome(errors)
    order = np.argsort(syndromes, kind="stable")
    counts = np.bincount(syndromes, minlength=2048)
    table = np.zeros((2048, counts.max()), np.uint32)
    table[syndromes[order], np.arange(len(errors)) - np.repeat(np.cumsum(counts) - counts, counts)] = errors[order]
    return table, counts


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generating polynomial."""
    rest = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> np.uint32(bit)) & np.uint32(1)) * np.uint32(_GOLAY << (bit - 11))
    return rest


def codewords_near(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codeword indices within 4 of 16-bit ``segments``, padded with zeros; each row's nearest comes first."""
    table, counts = _cosets()
    words = segments.astype(np.uint32) << np.uint32(7)
    of = _syndrome(words)
    rows = np.repeat(np.arange(len(words)), counts[of])
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts[of]) - counts[of], counts[of])
    return rows, (words[rows] ^ table[of[rows], nth]) >> np.uint32(11)


def segment_keys(prints: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of uint64 ``prints``: with the nearest codewords only, or with all within 4."""
    parts = [((prints >> np.uint64(16 * i)) & np.uint64(0xFFFF)) for i in range(4)]
    found = [codewords_near(p) for p in parts]
    if not near:
        found = [(np.unique(rows), index[np.unique(rows, return_index=True)[1]]) for rows, index in found]
    rows_out, keys = [], []
    for i, others in _OTHERS.items():
        for j in others:
            rows, index = found[j]
            rows_out.append(rows)
            keys.append((np.uint64(i * 4 + j) << np.uint64(28)) | (parts[i][rows] << np.uint64(12)) | index.astype(np.uint64))
    return np.concatenate(rows_out), np.concatenate(keys).astype(np.int64)


def _exploded(prints: DataFrame, make) -> DataFrame:
    """Rows ``key, fp, side`` that ``make`` yields as (row numbers, keys, side) for slices of the fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 512):
                part = every[at : at + 512]
                for rows, keys, side in make(part):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.astype(np.int64)), pa.array(part[rows].view(np.int64)), pa.array(np.full(len(rows), side, np.int8))], ["key", "fp", "side"]
                    )

    return prints.mapInArrow(run, "key long, fp long, side byte")


def _around(radius: int, side: int):
    flips = np.array([sum(1 << b for b in bits) for w in range(radius + 1) for bits in combinations(range(64), w)], np.uint64)

    def make(prints: np.ndarray):
        yield np.repeat(np.arange(len(prints)), len(flips)), (prints[:, None] ^ flips).ravel().view(np.int64), side

    return make


def links(prints: DataFrame, crowd: int = 64) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints at most 3 bits apart that connect all such pairs (in crowds, a tree of them)."""
    first = written(_exploded(prints, lambda p: [(*segment_keys(p, False), 0)]), "simhash-keys")
    second = _exploded(prints, lambda p: [(*segment_keys(p, True), 1)])
    crowded = written(first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "simhash-crowds")
    a, b = first.select("key", F.col("fp").alias("a")), second.select("key", F.col("fp").alias("b"))
    if crowded.isEmpty():
        dense = None
    else:
        inner, outer = a.join(crowded, "key", "left_semi"), b.join(crowded, "key", "left_semi")
        a, b = a.join(crowded, "key", "left_anti"), b.join(crowded, "key", "left_anti")
        points = _exploded(inner.select(F.col("a").alias("fp")).distinct(), _around(2, 0))
        points = points.union(_exploded(outer.select(F.col("b").alias("fp")).distinct(), _around(1, 1)))
        points = written(points, "simhash-points")
        least = points.groupBy("key").agg(
            F.min(F.when(F.col("side") == 0, F.col("fp"))).alias("a0"), F.min(F.when(F.col("side") == 1, F.col("fp"))).alias("b0")
        )
        tied = points.join(grown(least.where("a0 IS NOT NULL AND b0 IS NOT NULL")), "key")
        dense = tied.select("fp", F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("a0")).alias("to")).where("fp <> to").distinct()
    pairs = a.join(grown(b), "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3))
    pairs = pairs.select("a", "b")
    return pairs if dense is None else pairs.union(dense)


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (doc_id, text; other columns are left out).

    Documents link if their fingerprints differ in at most 3 bits; the component is the smallest id that links lead to, itself
    included. Null and empty texts have fingerprint 0 and link like others; null ids count as no id (their component may be
    null); repeated rows are repeated; no rows give no rows.
    """
    prints = written(fingerprints(docs, width), "simhash")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(least.select("fp")))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
