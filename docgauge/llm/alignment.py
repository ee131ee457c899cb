"""Alignment of two tokenizers over a corpus: which tokens of A lie on which tokens of B, and in how many documents.

Both tokenizers spell the same bytes (a space and the text). Offsets where a token of A and one of B end together cut them into groups. Between
two neighbouring ends of either side lies one token of each, so every such stretch is one link, and a text's links are the union of its ends.

Most groups are one token of A on one of B with the same bytes. An array from A's ids to B's ids with the same bytes is computed once
(``identity``); pairs that it names are counted in a vector as long as A's vocabulary, one per task, and looked up in it. Only the other
pairs, from irregular groups, are rows that are shuffled: once for each slice of documents that holds them, however often it does. Their
totals are joined back to the slices, which read the numbers of their documents from them.

Python works on numpy arrays of a slice; what the driver holds is as long as A's vocabulary. The tokenizers' files are read once, by the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from docgauge.llm.common import written

FOLDER = "/opt/tokenizers"
#: Split of byte-level BPE before merging (fixed with that vocabulary).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters only, whose classes all versions of Unicode agree on, take the faster of two equal encoders.
_SETTLED = regex.compile(r"[\x00-\u024F\u2010-\u2027\u2030-\u205E\u20AC]*")
_B_BITS = 24


def byte_alphabet() -> dict[str, int]:
    """The character by which byte-level BPE writes each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Tokenizers A (byte-level BPE, JSON) and B (sentencepiece) with the bytes of every token."""

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        alphabet = byte_alphabet()
        told = json.loads(a_json)
        special = {t["id"] for t in told["added_tokens"]}
        self.slow = Tokenizer.from_str(a_json.decode())
        self.slow.encode_special_tokens = True
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
        self.fast = self._encoding(told, special)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes: list[bytes] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        by_bytes = {spelled: i for i, spelled in reversed(list(enumerate(self.b_bytes))) if not self.b.is_byte(i)}
        self.identity = np.array([by_bytes.get(spelled, -1) for spelled in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_names = [f"{i}{end}" for end in ",|" for i in range(len(self.a_bytes))]
        self.b_names = [f"{i}{end}" for end in ",;" for i in range(len(self.b_bytes))]

    def _encoding(self, told: dict, special: set[int]) -> tiktoken.Encoding | None:
        """A as ranks, if its merges come in the order of its ids and it splits as expected; else None."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        vocabulary = told["model"]["vocab"]
        ordered = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        split = told["pre_tokenizer"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not told.get("normalizer")
        if not (ordered and plain):
            return None
        ranks = {spelled: i for i, spelled in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None and _SETTLED.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(1)
def pair_of(a_json: bytes, b_model: bytes) -> Pair:
    return Pair(a_json, b_model)


def aligned(pair: Pair, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Numbers per text (n_a, n_b, n_groups, n_links), hashes of the groups, and text number and (A id, B id) key of every link."""
    a_ids: list[int] = []
    b_ids: list[int] = []
    n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    full = [i for i, t in enumerate(texts) if t]
    for i, ids in zip(full, pair.b.encode([texts[i] for i in full], num_threads=1)):
        spelled = b" " + texts[i].encode()
        of_a = pair.encode_a(" " + texts[i])
        if b"".join([pair.a_bytes[x] for x in of_a]) == spelled and b"".join([pair.b_bytes[x] for x in ids]) == spelled:
            a_ids += of_a
            b_ids += ids
            n_a[i], n_b[i] = len(of_a), len(ids)
    a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
    a_end, b_end = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    ends = np.union1d(a_end, b_end)
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    last = np.cumsum(n_a)
    edge = np.concatenate(([0], a_end))[last]  # where each text's bytes end
    text = np.searchsorted(edge, ends)
    found = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(np.searchsorted(edge, common), minlength=len(texts)), "n_links": np.bincount(text, minlength=len(texts))}
    keys = a[np.searchsorted(a_end, ends)] << _B_BITS | b[np.searchsorted(b_end, ends)]
    return found, _digests(pair, a, b, a_end, b_end, common, n_a, n_b), text, keys


def _digests(pair: Pair, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
    """SHA-256 of every text's groups as ``a1,a2|b1;a3|b2,b3``; without tokens the empty string."""
    a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
    in_a, in_b = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
    names = np.empty(len(a) + len(b), np.int64)
    closes_a, closes_b = np.isin(a_end, common, assume_unique=True), np.isin(b_end, common, assume_unique=True)
    size_a = len(pair.a_bytes)
    names[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]] = a + size_a * closes_a
    names[np.arange(len(b)) + np.cumsum(in_a)[b_group]] = 2 * size_a + b + len(pair.b_bytes) * closes_b
    spelled = pair.a_names + pair.b_names
    told = [spelled[i] for i in names.tolist()]
    out, at = [], 0
    for n in (n_a + n_b).tolist():
        out.append(hashlib.sha256("".join(told[at : at + n])[:-1].encode()).hexdigest() if n else "")
        at += n
    return out


def _packed(values: np.ndarray) -> bytes:
    """Small unsigned numbers, byte plane by byte plane, of which the high ones are mostly zero."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_SLICES = (
    "slice long, doc_id array<long>, groups_sha256 array<string>, "
    + ", ".join(f"{n} array<long>" for n in _NUMBERS)
    + ", n_pairs array<long>, pairs array<long>, docs array<int>, held long, places binary, times binary"
)


def _slices(docs: DataFrame, files: tuple[bytes, bytes], slice_bytes: int) -> DataFrame:
    """Rows of documents with what their alignment gives: the distinct pairs of the slice (``pairs``) with the number of its documents that
    hold each (``docs``), and for every document the places of its own pairs there and how often it links them, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*files)
        task, made = TaskContext.get().partitionId(), 0
        parts: list[tuple] = []

        def whole() -> pa.RecordBatch:
            ids, numbers, hashes, n_pairs, keys, times = ([p[i] for p in parts] for i in range(6))
            keys = np.concatenate(keys)
            pairs, place = np.unique(keys, return_inverse=True)
            n_pairs = np.concatenate(n_pairs)
            steps = np.diff(place, prepend=0)
            firsts = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
            steps[firsts] = place[firsts]  # differences within each document, whose places rise
            columns = [
                pa.array([task << 32 | made]), pa.array([[i for some in ids for i in some]], pa.list_(pa.int64())), pa.array([[h for some in hashes for h in some]]),
                *[pa.array([np.concatenate([n[name] for n in numbers])], pa.list_(pa.int64())) for name in _NUMBERS],
                pa.array([n_pairs], pa.list_(pa.int64())), pa.array([pairs], pa.list_(pa.int64())),
                pa.array([np.bincount(place, minlength=len(pairs)).astype(np.int32)], pa.list_(pa.int32())), pa.array([len(keys)]),
                pa.array([_packed(steps)], pa.binary()), pa.array([_packed(np.concatenate(times))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SLICES.split(", ")])

        held = 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(ids):
                some, size = [], 0
                while at + len(some) < len(ids) and size < 500_000:
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1] or "")
                numbers, hashes, text, keys = aligned(pair, some)
                order = np.lexsort((keys, text))
                text, keys = text[order], keys[order]
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(keys, prepend=-1) != 0))
                times = np.diff(np.append(new, len(keys)))
                parts.append((ids[at : at + len(some)], numbers, hashes, np.bincount(text[new], minlength=len(some)), keys[new], times))
                at += len(some)
                held += size
                if held >= slice_bytes:
                    yield whole()
                    parts, held, made = [], 0, made + 1
        if parts:
            yield whole()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SLICES)


def _identity_docs(slices: DataFrame, identity: np.ndarray) -> DataFrame:
    """``a, n``: in how many documents each id of A lies on its same-bytes id of B, summed in a vector per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(identity), np.int64)
        for batch in batches:
            for pairs, docs in zip(batch.column("pairs"), batch.column("docs")):
                keys, n = pairs.values.to_numpy(), docs.values.to_numpy()
                a = keys >> _B_BITS
                regular = identity[a] == keys & ((1 << _B_BITS) - 1)
                vector[a[regular]] += n[regular]
        some = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(vector[some])], ["a", "n"])

    return slices.select("pairs", "docs").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _irregular(slices: DataFrame, identity: np.ndarray) -> DataFrame:
    """``slice, pair, docs``: the pairs of a slice that the identity does not name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, docs in zip(batch.column("slice").to_pylist(), batch.column("pairs"), batch.column("docs")):
                keys = pairs.values.to_numpy()
                odd = np.flatnonzero(identity[keys >> _B_BITS] != keys & ((1 << _B_BITS) - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(odd), number)), pa.array(keys[odd]), docs.values.take(pa.array(odd))], ["slice", "pair", "docs"]
                )

    return slices.select("slice", "pairs", "docs").mapInArrow(run, "slice long, pair long, docs int")


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    """``a, n`` rows, at most one per id of A, as a vector."""
    out = np.zeros(size, np.int64)
    for row in rows.toLocalIterator():
        out[row["a"]] = row["n"]
    return out


def pair_counts(slices: DataFrame, identity: np.ndarray) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The vector of identity counts, the irregular rows and their totals (``pair, total``)."""
    odd = written(_irregular(slices, identity), "align-irregular")
    totals = written(odd.groupBy("pair").agg(F.sum("docs").alias("total")), "align-totals")
    return _vector(_identity_docs(slices, identity), len(identity)), odd, totals


def align(docs: DataFrame, folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", slice_bytes: int = 8_000_000) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs`` (doc_id, text).

    ``n_best``: links whose pair is held by as many documents as any pair of their A id; ``count_sum``: sum over the links of the number of
    documents that hold their pair; a repeated row counts as a document. Texts that are null, empty, or that a tokenizer does not spell byte
    for byte have no tokens: zeros and an empty hash. Null ids are kept; other columns are left out; no rows give no rows.
    ``slice_bytes``: about how many characters of text share a row of working state.
    """
    files = tuple(open(f"{folder}/{name}", "rb").read() for name in (a, b))
    identity = pair_of(*files).identity
    slices = written(_slices(docs, files, slice_bytes), "align-slices")
    vector, odd, totals = pair_counts(slices, identity)
    top = totals.groupBy(F.shiftright("pair", _B_BITS).alias("a")).agg(F.max("total").alias("n"))
    best = np.maximum(vector, _vector(top, len(identity)))
    back = odd.select("slice", "pair").join(totals, "pair")

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("pair").to_numpy())
        odd_pairs, odd_totals = told.column("pair").to_numpy()[order], told.column("total").to_numpy()[order]
        out = []
        for row in own.to_pylist():
            pairs = np.array(row["pairs"], np.int64)
            a_ids = pairs >> _B_BITS
            regular = identity[a_ids] == pairs & ((1 << _B_BITS) - 1)
            count = np.zeros(len(pairs), np.int64)
            count[regular] = vector[a_ids[regular]]
            count[~regular] = odd_totals[np.searchsorted(odd_pairs, pairs[~regular])]
            is_best = count == best[a_ids]
            n_pairs = np.array(row["n_pairs"], np.int64)
            doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
            steps, times = _numbers(row["places"], row["held"]), _numbers(row["times"], row["held"])
            sums = np.cumsum(steps)
            before = np.concatenate(([0], sums))[np.cumsum(n_pairs) - n_pairs]
            place = sums - np.repeat(before, n_pairs)
            n_best, count_sum = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
            np.add.at(n_best, doc, times * is_best[place])
            np.add.at(count_sum, doc, times * count[place])
            columns = [row["doc_id"], *[row[n] for n in _NUMBERS], n_best, count_sum, row["groups_sha256"]]
            kinds = [pa.int64()] * 7 + [pa.string()]
            out.append(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", n_best long, count_sum long, groups_sha256 string"
    own = slices.drop("docs").groupBy("slice")
    return own.cogroup(back.groupBy("slice")).applyInArrow(run, schema)
