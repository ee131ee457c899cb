"""Similarity join of shingle sets with a tree over their count vectors.

A set's shingles are hashed into groups, and the numbers per group are a point. Two sets share at most the sum, over the groups, of the lesser of
their two counts; below 4/9 of their sizes together (for a similarity of 0.8) they cannot link. The bound is used from the top down:

* Regions. With as many groups as there are hashes, a point is 0 or 1 in each. Put the groups in one order for all: if two points share none of
  the first ``n - ceil(0.8 n) + 1`` groups of either, the minima of the others sum to less than needed. So a point is entered into the region
  of each of its first groups, and only points of one region are compared. Groups that many points share come last in the order (a table of
  fixed size counts them over all documents), so a passage that unlike documents share is no region of theirs unless they hold little else.
* Nodes. Within a region points have ``GROUPS`` coordinates. They are packed by size and widest coordinate into leaves with their
  greatest counts; two leaves are opened if the minima of those reach what their least sizes need.
* Points. Pairs in opened leaves must reach the bound with their own counts, and must not differ too often in ``BITS`` parities of finer
  groups: each parity that differs is a shingle that only one of the two has.

Only components are asked for, so no step writes its pairs. A task joins the points of its pairs to clusters and writes each point once, with the
least of its cluster; clusters of all tasks are merged. Only sets of one cluster can link. Their whole sets are read, once, and come together
by cluster, in tiles if the cluster is crowded, so no task holds more than two tiles; what links is again written as one row a point.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from docgauge.llm.collocation import _powers
from docgauge.llm.common import written
from docgauge.llm.graph import components
from docgauge.llm.wordhash import mixed, runs

GROUPS = 32
#: Parities kept beside the counts, one bit each.
BITS = 1024
_TABLE = 1 << 22
_BLOCK = 1 << 16
_LEAF = 16
#: Points or copies whose keys (40 bytes each at most) are sent to all tasks; more are joined by a shuffle.
_FEW = 250_000
#: Regions up to this size are compared point by point, many at once.
_SMALL = 48
#: Pairs of rows that a task compares before it joins them to clusters.
_PAIRS = 4_000_000
#: Parities of a whole set, compared before the sets of a cluster move.
_FINE = 1 << 14
_BASE = 0x9FB21C651E98DF25 | 1
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: 64 bits over the hashes of its words, all texts at once."""
    encoded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    edges = np.diff((~_BLANK[data]).astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    text = np.searchsorted(np.cumsum(np.array([len(t) + 1 for t in encoded], np.int64)), begin, "right")
    powers, back = _powers(_BASE, len(data)), _powers(pow(_BASE, -1, 1 << 64), len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    words = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    hashes, first = runs(words, text, width)
    counts = np.bincount(text, minlength=len(texts))
    cuts = np.searchsorted(text[first], np.arange(1, len(texts)))
    out = [np.unique(part) for part in np.split(hashes, cuts)]
    for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():  # too short: all words as one
        n = int(counts[i])
        at = int(np.searchsorted(text, i))
        out[i] = runs(words[at : at + n], text[at : at + n], n)[0] + np.uint64(n)
    return out


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts some at a time, each time with the number of those before."""
    at = 0
    while at < len(texts):
        some: list[str | None] = []
        size = 0
        while at + len(some) < len(texts) and size < 1_000_000 and len(some) < 1024:
            some.append(texts[at + len(some)].as_py())
            size += len(some[-1] or "")
        yield at, some
        at += len(some)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(_TABLE - 1)).astype(np.int64)


def commonness(docs: DataFrame, width: int) -> np.ndarray:
    """For each slot of a hash how far the shingles of all documents in it exceed the mean, as a power of two; 0 for most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_TABLE, np.int64)
        for batch in batches:
            for _, some in _slices(batch.column("text")):
                np.add.at(counts, _slots(np.concatenate(shingle_sets(some, width))), 1)
        full = [b for b in range(_TABLE // _BLOCK) if counts[b * _BLOCK : (b + 1) * _BLOCK].any()]
        blobs = [pa.compress(counts[b * _BLOCK : (b + 1) * _BLOCK].view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) for b in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(blobs, pa.binary())], ["block", "counts"])

    def unpacked(blob: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(pa.decompress(blob, 8 * _BLOCK, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T).view(np.int64).ravel()

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts")):
                sums[block] = sums.get(block, 0) + unpacked(blob.as_py())
        blobs = [pa.compress(v.tobytes(), codec="zstd", asbytes=True) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(blobs, pa.binary())], ["block", "counts"])

    schema = "block long, counts binary"
    counts = np.zeros(_TABLE, np.int64)
    for row in docs.select("text").mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).toLocalIterator():
        counts[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(pa.decompress(bytes(row["counts"]), 8 * _BLOCK, codec="zstd", asbytes=True), np.int64)
    mean = counts.mean()
    over = np.maximum(counts - mean - 4 * np.sqrt(mean) - 8, 0)
    return np.ceil(np.log2(over + 1)).astype(np.uint8)


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether an odd number of shingles lies in each of ``bits`` (a power of two, 64 or more) groups, packed into 64-bit numbers."""
    odd = np.bincount((hashes >> np.uint64(26)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def count_vector(hashes: np.ndarray) -> bytes:
    """How many shingles lie in each of ``GROUPS`` groups (65,535 stands for that many or more), then ``BITS`` parities."""
    grouped = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(grouped, 65535).astype("<u2").tobytes() + parities(hashes, BITS).tobytes()


def _unpacked(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and parities of some ``count_vector``s."""
    rows = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, 2 * GROUPS + BITS // 8)
    return np.ascontiguousarray(rows[:, : 2 * GROUPS]).view("<u2").astype(np.int32), np.ascontiguousarray(rows[:, 2 * GROUPS :]).view(np.uint64)


def _near(a: np.ndarray, b: np.ndarray, n_a: np.ndarray | int, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether parities differ no more often than sets of the wanted similarity may: each that differs is a shingle of one set alone."""
    return (100 + percent) * np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= (100 - percent) * (n_a + n_b)


def count_vectors(sets: DataFrame) -> DataFrame:
    """``row, counts`` for rows of ``doc_id, shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [count_vector(s.values.to_numpy().view(np.uint64)) for s in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(vectors, pa.binary())], ["row", "counts"])

    return sets.select("doc_id", "shingles").mapInArrow(run, "row long, counts binary")


_POINTS = "row long, doc_id long, k long, k2 int, n long, digest binary, regions array<long>, counts binary"


def _points(docs: DataFrame, common: np.ndarray, width: int, percent: int) -> DataFrame:
    """One row per document: size and digest of its set, its first groups (``regions``) and its counts in ``GROUPS`` groups."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 36, 0
        order_of = shared.value
        for batch in batches:
            for at, some in _slices(batch.column("text")):
                part = batch.slice(at, len(some))
                sizes, digests, regions, counts = [], [], [], []
                for hashes in shingle_sets(some, width):
                    n = len(hashes)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    first = n - -(-percent * n // 100) + 1 if n else 0
                    order = np.lexsort((hashes, order_of[_slots(hashes)]))[:first]
                    regions.append(hashes[order].view(np.int64))
                    counts.append(count_vector(hashes))
                rows = pa.array(np.arange(task + made, task + made + part.num_rows))
                made += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        rows, part.column("doc_id"), part.column("k"), part.column("k2"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                        pa.array(regions, pa.list_(pa.int64())), pa.array(counts, pa.binary()),
                    ],
                    [c.split()[0] for c in _POINTS.split(", ")],
                )

    return docs.select("doc_id", "k", "k2", "text").mapInArrow(run, _POINTS)


def _reaches(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether summed minima and sizes of points (or of leaves: greatest counts, least sizes) allow the wanted similarity."""
    minima = np.minimum(a, b).sum(-1, dtype=np.int64)
    unbounded = (a == 65535).any(-1) | (b == 65535).any(-1)
    return unbounded | ((100 + percent) * minima >= percent * (n_a + n_b))


def tree_pairs(counts: np.ndarray, n: np.ndarray, root: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of different roots that the bounds allow, by a packed tree: leaves of ``_LEAF`` points, opened two at a time."""
    wide = int(np.argmax(counts.astype(np.float64).var(0) / (counts.mean(0) + 1)))
    slab = np.argsort(np.argsort(n, kind="stable"), kind="stable") // (_LEAF * max(1, int((len(n) / _LEAF) ** 0.5)))
    order = np.lexsort((counts[:, wide], slab))
    starts = np.arange(0, len(n), _LEAF)
    high, small, large = np.maximum.reduceat(counts[order], starts), np.minimum.reduceat(n[order], starts), np.maximum.reduceat(n[order], starts)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(len(starts)):
        others = np.arange(i, len(starts))
        fits = (100 * large[others] >= percent * small[i]) & (100 * large[i] >= percent * small[others])
        others = others[fits & _reaches(high[i], high[others], small[i], small[others], percent)]
        if len(others):
            mine = order[starts[i] : starts[i] + _LEAF]
            them = np.concatenate([order[starts[j] : starts[j] + _LEAF] for j in others.tolist()])
            ordinal = np.concatenate([np.arange(starts[j], min(starts[j] + _LEAF, len(n))) for j in others.tolist()])
            x, y = np.repeat(mine, len(them)), np.tile(them, len(mine))
            after = np.tile(ordinal, len(mine)) > np.repeat(np.arange(starts[i], starts[i] + len(mine)), len(them))
            out.append(_kept(x[after], y[after], counts, n, root, percent))
    return tuple(np.concatenate(side) for side in zip(*out))


def _kept(x: np.ndarray, y: np.ndarray, counts: np.ndarray, n: np.ndarray, root: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    fits = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    x, y = x[fits], y[fits]
    near = np.concatenate([_reaches(counts[x[k : k + 50_000]], counts[y[k : k + 50_000]], n[x[k : k + 50_000]], n[y[k : k + 50_000]], percent) for k in range(0, max(1, len(x)), 50_000)])
    return x[near], y[near]


def region_pairs(key: np.ndarray, counts: np.ndarray, n: np.ndarray, root: np.ndarray, node: np.ndarray, star: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs to verify, for whole regions in order of their keys; with ``star`` only one point's pairs per region and root."""
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    size = np.diff(np.append(new, len(key)))
    if star:
        order = np.lexsort((node, root, np.repeat(np.arange(len(new)), size)))
        first = np.repeat(order[new], size)
        of = np.repeat(np.arange(len(new)), size)
        apart = root[order] != root[first]
        at = np.flatnonzero(apart)
        groups, where = np.unique(of[at], return_index=True)
        second = np.full(len(new), -1)
        second[groups] = order[at[where]]
        inner = np.flatnonzero(~apart & (second[of] >= 0))
        x, y = np.concatenate((first[at], second[of[inner]])), np.concatenate((order[at], order[inner]))
        return _kept(x, y, counts, n, root, percent)
    out = []
    small = np.repeat(size <= _SMALL, size)
    for step in range(1, min(int(size.max(initial=0)), _SMALL)):
        x = np.flatnonzero((key[:-step] == key[step:]) & small[:-step])
        out.append(_kept(x, x + step, counts, n, root, percent))
    for i in np.flatnonzero(size > _SMALL).tolist():
        part = slice(new[i], new[i] + size[i])
        out.append(tuple(new[i] + side for side in tree_pairs(counts[part], n[part], root[part], percent)))
    return tuple(np.concatenate(side) for side in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def joined(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` points the least one that the pairs ``x, y`` connect it with."""
    low = np.arange(n)
    while (low[x] != low[y]).any():
        a, b = low[x], low[y]
        least = np.minimum(a, b)
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        while (low[low] != low).any():
            low = low[low]
    return low


def clustered(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b`` for regions (key, node, n, counts, root) whose rows come together: each point ``b`` of a pair that the bounds allow, with the
    least point ``a`` that such pairs of a task connect it with. A task writes a point once, however many pairs it has."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, node, n, root = (table.column(c).to_numpy() for c in ("key", "node", "n", "root"))
        counts, bits = _unpacked(table.column("counts").to_pylist())
        points, place = np.unique(node, return_inverse=True)
        new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        size = np.diff(np.append(new, len(key)))
        part = np.cumsum(size.astype(np.int64) ** 2) // _PAIRS  # some regions at a time, for memory
        low = np.arange(len(points))
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            at = slice(new[mine[0]], new[mine[-1]] + size[mine[-1]])
            x, y = region_pairs(key[at], counts[at], n[at], root[at], node[at], False, percent)
            near = [_near(bits[at][x[k : k + 50_000]], bits[at][y[k : k + 50_000]], n[at][x[k : k + 50_000]], n[at][y[k : k + 50_000]], percent) for k in range(0, len(x), 50_000)]
            if near:
                near = np.concatenate(near)
                here = np.arange(len(points))
                low = joined(len(points), np.concatenate((here, place[at][x[near]])), np.concatenate((low, place[at][y[near]])))
        b = np.flatnonzero(low != np.arange(len(points)))
        return pa.RecordBatch.from_arrays([pa.array(points[low[b]]), pa.array(points[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 50_000:
                whole = pa.Table.from_batches(held)
                key = whole.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last region may go on
                if last:
                    yield solve(whole.slice(0, last))
                    held = whole.slice(last).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long").distinct()


def tiled(boxes: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """The rows of ``boxes`` with a ``key`` for the region, or for the pair of tiles of a region of more than ``tile`` points."""
    rows = boxes.join(sizes, "region")
    return _dealt(rows, "region", tile).select("key", "node", "n", "counts", "root").repartition("key").sortWithinPartitions("key")


def _dealt(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """The rows (``m``: how many their group has) with ``key``, ``pair`` and ``mine``: once for each pair of tiles that their own is in."""
    tiles = F.ceil(F.col("m") / tile).cast("int")
    mine = F.pmod(F.xxhash64("node"), tiles).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(t, mine).alias("i"), F.greatest(t, mine).alias("j")))
    return rows.withColumns({"mine": mine, "pair": F.explode(pairs)}).withColumn("key", F.xxhash64(group, "pair.i", "pair.j"))


def _sets(docs: DataFrame, points: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``row, shingles`` of the points in ``nodes``. Each point's text is that of one row: its id and two hashes find it, and only where a
    row is repeated are its copies dropped."""
    key = ["id", "k", "k2"]
    named = points.select("row", F.coalesce("doc_id", F.lit(-1)).alias("id"), "k", "k2")
    wanted = named.join(nodes.withColumnRenamed("node", "row"), "row", "left_semi")
    same = named.drop("row").join(wanted, key, "left_semi")
    wanted = written(wanted.join(same.groupBy(*key).agg(F.count("*").alias("times")), key), "sets-wanted")
    if wanted.count() <= _FEW:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _slices(batch.column("text")):
                sets = [s.view(np.int64) for s in shingle_sets(some, width)]
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("times"), pa.array(sets, pa.list_(pa.int64()))], ["row", "times", "shingles"])

    texts = docs.withColumn("id", F.coalesce("doc_id", F.lit(-1))).join(wanted, key).select("row", "times", "text")
    found = written(texts.mapInArrow(run, "row long, times long, shingles array<long>"), "sets")
    repeats = found.where("times > 1").select("row", "shingles").dropDuplicates(["row"])
    return found.where("times = 1").select("row", "shingles").union(repeats)


def links_within(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, share: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (numbers, none empty) of similarity ``share`` that connect what such pairs connect: as many as join different components.

    ``root``: sets of one root are connected already. ``side``: with two different ones only pairs from one to the other are looked at.
    """
    size = np.array([len(s) for s in sets], np.int64)
    bits = max(64, min(1 << 15, 1 << int(4 * size.max()).bit_length()))
    odd = np.stack([parities(s, bits) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    held = np.zeros(int(ids.max()) + 1, bool)
    component = np.unique(root, return_inverse=True)[1]
    num, den = share.numerator, share.denominator
    two = side.min() != side.max()
    found: list[tuple[int, int]] = []
    for x in range(len(sets)):
        other = np.arange(x + 1, len(sets))
        fits = (component[other] != component[x]) & (den * np.minimum(size[other], size[x]) >= num * np.maximum(size[other], size[x]))
        other = other[fits & (side[other] != side[x])] if two else other[fits]
        differ = np.bitwise_count(odd[other] ^ odd[x]).sum(-1, dtype=np.int64)
        other = other[(den + num) * differ <= (den - num) * (size[other] + size[x])]
        if not len(other):
            continue
        mine = ids[start[x] : start[x] + size[x]]
        held[mine] = True
        for k in range(0, len(other), 256):
            some = other[k : k + 256]
            ends = np.cumsum(size[some])
            within = np.arange(ends[-1]) + np.repeat(start[some] - ends + size[some], size[some])
            both = np.add.reduceat(held[ids[within]].astype(np.int64), ends - size[some])
            for y in some[den * both >= num * (size[some] + size[x] - both)].tolist():
                if component[y] != component[x]:
                    component[component == component[y]] = component[x]
                    found.append((x, y))
        held[mine] = False
    return tuple(np.array(f, np.int64) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _members(edges: DataFrame) -> DataFrame:
    """``row, cluster`` of all points of ``edges``."""
    clusters = components(edges)
    heads = clusters.select(F.col("root").alias("row"), F.col("root").alias("cluster")).distinct()
    return clusters.toDF("row", "cluster").union(heads)


def refined(sets: DataFrame, members: DataFrame, share: Fraction, tile: int) -> DataFrame:
    """``a, b``: stars of the clusters that are left of ``members`` (row, cluster) where only sets (row, root, shingles) are connected that
    ``_FINE`` parities allow to link. Two kilobytes a set move to the tiles of a crowded cluster, not the sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [v.values.to_numpy().view(np.uint64) for v in batch.column("shingles")]
            odd = pa.array([parities(v, _FINE).tobytes() for v in each], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(v) for v in each], pa.int64()), odd], ["node", "n", "odd"])

    def solve(held: list[tuple]) -> pa.RecordBatch:
        node, n = (np.array([h[i] for h in held]) for i in (1, 2))
        odd = np.frombuffer(b"".join(h[3] for h in held), np.uint64).reshape(len(held), -1)
        component = np.arange(len(held))
        num, den = share.numerator, share.denominator
        for x in range(len(held)):
            other = np.arange(x + 1, len(held))
            other = other[(component[other] != component[x]) & (den * np.minimum(n[other], n[x]) >= num * np.maximum(n[other], n[x]))]
            differ = np.bitwise_count(odd[other] ^ odd[x]).sum(-1, dtype=np.int64)
            near = other[(den + num) * differ <= (den - num) * (n[other] + n[x])]
            if len(near):
                component[np.isin(component, component[near])] = component[x]
        first = np.unique(component, return_index=True, return_inverse=True)[1:]
        head = first[0][first[1]]
        b = np.flatnonzero(head != np.arange(len(held)))
        return pa.RecordBatch.from_arrays([pa.array(node[head[b]]), pa.array(node[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n", "odd"))):
                if held and row[0] != held[0][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    sizes = members.groupBy("cluster").agg(F.count("*").cast("int").alias("m"))
    sketches = sets.select("row", "shingles").mapInArrow(sketch, "node long, n long, odd binary")
    rows = sketches.join(members.join(sizes, "cluster").withColumnRenamed("row", "node"), "node")
    rows = _dealt(rows, "cluster", tile).select("key", "node", "n", "odd").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long").distinct()


def linked(sets: DataFrame, edges: DataFrame, share: Fraction, tile: int) -> DataFrame:
    """``a, b``: pairs of whole sets (row, shingles, and perhaps root: what is connected already) of similarity ``share``, within the clusters
    that ``edges`` (a, b) connect. Every link within a cluster is between points that these pairs and roots connect; there are fewer than
    points in a task, however many pairs link. Sets move once, or once for each tile of a crowded cluster."""
    sets = sets.where(F.size("shingles") > 0)
    members = _members(written(refined(sets, _members(edges), share, tile), "sets-refined"))
    if "root" not in sets.columns:
        sets = sets.withColumn("root", F.col("row"))
    # Sets of over a thousand shingles count for several, so that a tile has bounded memory.
    weight = F.greatest(F.count("*"), F.ceil(F.sum(F.size("shingles")) / 1024)).cast("int").alias("m")
    sizes = sets.join(members, "row").groupBy("cluster").agg(weight)
    rows = sets.join(members.join(sizes, "cluster"), "row").withColumnRenamed("row", "node")
    rows = _dealt(rows, "cluster", tile).select("key", "node", "root", F.when(F.col("pair.i") == F.col("pair.j"), 0).otherwise(F.col("mine")).alias("side"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            node, root, side = (np.array([h[i] for h in held]) for i in (1, 2, 3))
            x, y = links_within([h[4] for h in held], root, side, share)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("key", "node", "root", "side")]
            for i, row in enumerate(zip(*plain)):
                if held and row[0] != held[0][0]:
                    yield from solve(held)
                    held = []
                held.append((*row, batch.column("shingles")[i].values.to_numpy().view(np.uint64).copy()))
        if held:
            yield from solve(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _crowding(entered: DataFrame, percent: int) -> DataFrame:
    """``region, m`` of regions of several points, for rows of ``node, n, place, region``.

    A region of two, as most are that unlike documents share by chance, is left out where their sizes differ too much, or what follows it in
    their orders is too little: points that can link have their first common group nearer to the front, in a region of its own.
    """
    left = F.min(F.col("n") - F.col("place")).alias("left")
    sizes = entered.groupBy("region").agg(F.count("*").cast("int").alias("m"), F.min("n").alias("small"), F.max("n").alias("large"), left)
    fits = F.expr(f"100 * small >= {percent} * large AND {100 + percent} * left >= {percent} * (small + large)")
    return written(sizes.where((F.col("m") > 2) | ((F.col("m") == 2) & fits)).select("region", "m"), "sets-regions")


def similar_sets(docs: DataFrame, width: int = 5, percent: int = 80, tile: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text).

    A document's set are the runs of ``width`` words, A-Z in lower case; with fewer words all of them as one. Documents link if the common
    shingles of their sets are at least ``percent`` percent of all of both. The component is the smallest id that links lead to, itself
    included. Null texts and texts without words have empty sets and link with nothing. Rows with equal sets are one point, so
    repeated rows share a component; null ids link too but name no component (it is null where nothing else is linked). No rows give no
    rows; other columns are left out. ``tile``: points of a region that are compared at a time where it is crowded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"k": F.xxhash64("text"), "k2": F.hash("text")})
    points = written(_points(rows, commonness(rows, width), width, percent), "sets-points")
    heads = points.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    heads = written(heads, "sets-heads")
    # Rows whose set another row stands for: far fewer than points, which need not move to drop them.
    copies = written(points.where("n > 0").select("row", "digest").join(heads, "digest").where("row <> node").select("row"), "sets-copies")
    if copies.count() <= _FEW:
        copies = F.broadcast(copies)
    nodes = points.where("n > 0").select("row", "n", "regions", "counts").join(copies, "row", "left_anti").withColumnRenamed("row", "node")
    entered = nodes.select("node", "n", F.posexplode("regions").alias("place", "region"))
    sizes = _crowding(entered, percent)
    # Points are dealt to tiles as keys, written, and meet their counts only then: those move once.
    keys = written(_dealt(entered.select("node", "region").join(sizes, "region"), "region", tile).select("key", "node"), "sets-keys")
    boxes = keys.join(nodes.select("node", "n", "counts"), "node").withColumn("root", F.col("node"))
    edges = written(clustered(boxes.select("key", "node", "n", "counts", "root").repartition("key").sortWithinPartitions("key"), percent), "sets-clusters")
    alive = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "sets-alive")
    links = written(linked(_sets(rows, points, alive, width), edges, Fraction(percent, 100), tile), "sets-links")
    roots = None if links.isEmpty() else components(links)

    named = heads.select("digest", "node", "least")
    if roots is None:
        named = named.withColumn("component_id", F.col("least"))
    else:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(ids, "root")
    told = points.select("doc_id", "digest", "n").join(named.select("digest", "component_id", F.lit(True).alias("known")), "digest", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
