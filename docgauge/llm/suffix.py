"""Removal of every repeated string of ``length`` bytes, by a suffix sort whose comparisons use prefix hashes.

1. Texts are taken once each (copies are counted). Every string of ``length`` bytes has an anchor: of the ``gram``-byte grams
   inside it the one with the least hash, the first if equal. Equal strings have equal anchors at equal places, so only strings around anchors
   of one gram can be equal, and a gram that occurs once rules out all strings anchored at it.
2. For each anchor whose gram occurs again, the run of strings that it anchors is cut out with all their bytes (its context).
   Equal contexts of a gram are one row with a count: two or more mean that the whole run is repeated.
3. The strings of grams with several different contexts are sorted as suffixes: by their first eight bytes, and where these tie by a merge
   sort. It compares two suffixes by their longest common extension, found by binary search on the prefix polynomial hashes, and
   the byte after it. Neighbours that agree in ``length`` bytes by hash are verified byte by byte.
4. Repeated strings become spans of their texts, which are merged and cut.

Contexts of a gram that has more than ``crowd`` different ones are cut into pieces by the distance of their strings from the anchor. Equal
pieces are one row, so a passage that very many texts share is sorted once. All strings of a piece hold its core, so only pieces with equal
cores are compared: what lies around the passage differs there and drops out. Where over ``crowd`` different pieces share a core, these pieces,
one row each, are cut again into shorter ones, at last into single strings, which are their own core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from docgauge.llm.common import written

_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 18
#: Suffixes that are merged at a time.
_TIES = 50_000
#: Texts that come to a task at once.
_BATCH = 1_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


class Prefixes:
    """Prefix polynomial hashes (modulo 2^64) of a byte array: substrings hash and compare in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = data
        self.powers = _powers(_BASE, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.add(data, np.uint64(1), out=self.sums[1:])
        self.sums[1:] *= self.powers[:-1]
        np.cumsum(self.sums, out=self.sums)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether the n bytes from a and from b have equal hashes."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        return (self.sums[low + n] - self.sums[low]) * self.powers[high - low] == self.sums[high + n] - self.sums[high]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Longest common extension of a and b, up to ``most``, by binary search."""
        found = np.full(len(a), most, np.int64)
        open_ = np.flatnonzero(~self.same(a, b, most))
        low, high = np.zeros(len(open_), np.int64), np.full(len(open_), most - 1, np.int64)
        x, y = a[open_], b[open_]
        while len(low) and (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(x, y, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        found[open_] = low
        return found

    def before(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Whether suffix a sorts before suffix b, looking at ``most`` bytes."""
        n = self.common(a, b, most)
        at = np.minimum(n, most - 1)
        return (n < most) & (self.data[a + at] < self.data[b + at])

    def grams(self, size: int) -> np.ndarray:
        """A mixed hash of the ``size`` bytes at every position, whatever their position in the array."""
        h = self.sums[size:] - self.sums[:-size]
        h *= _powers(pow(_BASE, -1, 1 << 64), len(self.data))[: len(h)]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def suffix_sort(hashes: Prefixes, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes at ``starts`` within each group (groups come in order), by their first ``most`` (>= 8) bytes."""
    first = np.lib.stride_tricks.sliding_window_view(hashes.data, 8)[starts].copy().view(">u8").ravel().astype(np.uint64)
    order = np.lexsort((first, group))
    g, f = group[order], first[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    begin, size = begin[size > 1], size[size > 1]
    part = np.cumsum(size) // _TIES  # some ties at a time, for memory
    for p in np.unique(part):
        _merge_ties(hashes, starts, order, begin[part == p], size[part == p], most)
    return order


def _merge_ties(hashes: Prefixes, starts: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int) -> None:
    """Merge sort, in place, of the stretches of ``order`` that start at ``begin``: runs of one width in pairs, in all of them at once."""
    width = 1
    while len(begin):
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        base, end = np.repeat(begin, size), np.repeat(begin + size, size)
        run = (place - base) // width
        pair = base + (run // 2) * 2 * width
        right = run % 2 == 1
        low = np.where(right, pair, np.minimum(pair + width, end))
        other = low.copy()
        high = np.where(right, pair + width, np.minimum(pair + 2 * width, end))
        moved = order[place]
        mine = starts[moved]
        active = np.flatnonzero(low < high)
        while len(active):  # binary search for the place among the other run
            middle = (low[active] + high[active]) // 2
            them = starts[order[middle]]
            me, is_right = mine[active], right[active]
            goes_on = np.where(is_right, ~hashes.before(me, them, most), hashes.before(them, me, most))
            low[active] = np.where(goes_on, middle + 1, low[active])
            high[active] = np.where(goes_on, high[active], middle)
            active = active[low[active] < high[active]]
        order[pair + (place - pair - np.where(right, width, 0)) + (low - other)] = moved
        width *= 2
        begin, size = begin[size > width], size[size > width]


def repeated(hashes: Prefixes, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each start, whether the ``length`` bytes from it also lie at another start of its group."""
    out = np.zeros(len(starts), bool)
    order = suffix_sort(hashes, starts, group, length)
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero(group[a] == group[b])
    pairs = pairs[hashes.same(starts[a[pairs]], starts[b[pairs]], length)]
    view = np.lib.stride_tricks.sliding_window_view(hashes.data, length)
    for k in range(0, len(pairs), 20_000):
        some = pairs[k : k + 20_000]
        equal = (view[starts[a[some]]] == view[starts[b[some]]]).all(1)
        if not equal.all():  # a collision may have led the sort astray: compare this batch's strings themselves
            return _repeated_plainly(view, starts, group)
        out[a[some]] = out[b[some]] = True
    return out


def _repeated_plainly(view: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    seen: dict[tuple[int, bytes], list[int]] = {}
    for i, (g, s) in enumerate(zip(group.tolist(), starts.tolist())):
        seen.setdefault((g, view[s].tobytes()), []).append(i)
    out = np.zeros(len(starts), bool)
    for same in seen.values():
        out[same] = len(same) > 1
    return out


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, hash of the gram, place of the anchor, first string and number of strings of each run, for texts in ``data``."""
    long = ends - starts >= length
    starts, ends, number = starts[long], ends[long], np.flatnonzero(long)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h = Prefixes(data).grams(gram)
    wide = length - gram + 1
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    packed = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(packed) // wide) + 1
    padded = np.concatenate((packed, np.full(blocks * wide - len(packed), ~np.uint64(0)))).reshape(blocks, wide)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    runs = ends - starts - length + 1
    text = np.repeat(np.arange(len(starts)), runs)
    s = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs - starts, runs)
    at = (np.minimum(behind[s], ahead[s + wide - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    own = starts[text[first]]
    return number[text[first]], h[at[first]], at[first] - own, s[first] - own, count


def _bytes(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Texts that ``_distinct_texts`` has packed, one by one."""
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(t.as_buffer()) for t in batch.column("text"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a batch from and to, and their texts, some at a time."""
    texts: list[bytes] = []
    at = held = 0
    for i, t in enumerate(_bytes(batch), 1):
        texts.append(t)
        held += len(t)
        if held >= _SLICE or i == batch.num_rows:
            yield at, i, texts
            texts, at, held = [], i, 0


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    return np.frombuffer(b"".join(texts), np.uint8), starts, starts + sizes


def _firsts(batch: pa.RecordBatch, seen: set[tuple[int, int]]) -> list[int]:
    """Rows whose keys are not among those seen before."""
    keep = []
    for i, key in enumerate(zip(batch.column("k").to_pylist(), batch.column("k2").to_pylist())):
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return keep


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of equal keys in this task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = pa.array(_firsts(batch, seen), pa.int64())
        yield batch if len(keep) == batch.num_rows else batch.take(keep)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3).compress
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep, text = _firsts(batch, seen), batch.column("text")
        texts = pa.array([pack(text[i].as_buffer()) for i in keep], pa.binary())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("k2").take(at), texts], ["k", "k2", "text"])


def _distinct_texts(docs: DataFrame, partitions: int) -> DataFrame:
    """``k, k2, text``: every text once, packed, dealt by ``k``; each task drops the copies it sees before anything is shuffled."""
    kind = "k long, k2 int, text binary"
    return docs.select("k", "k2", "text").mapInArrow(_packed, kind).repartition(partitions, "k").mapInArrow(_once, kind)


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``g, k, k2, at``: anchors of all texts; ``at`` packs the first string of the run, the anchor's distance and the strings after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, keys2 = batch.column("k").to_numpy(), batch.column("k2").to_numpy()
            for a, b, some in _runs(batch):
                number, h, place, first, count = anchors(*_laid(some), length, gram)
                packed = first << 20 | (place - first) << 10 | (count - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(keys[a:b][number]), pa.array(keys2[a:b][number]), pa.array(packed)], ["g", "k", "k2", "at"]
                )

    return texts.mapInArrow(run, "g long, k long, k2 int, at long")


def _cut_contexts(texts: DataFrame, length: int) -> DataFrame:
    """``g, ch, k, k2, at, ctx``: each anchor with the hash of its context, whose bytes only the first in a task carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for k, k2, text, marks in zip(*(batch.column(c).to_pylist() for c in ("k", "k2")), _bytes(batch), batch.column("marks")):
                out: list[list] = [[], [], [], [], [], []]
                for mark in marks.as_py():
                    g, at = mark["g"], mark["at"]
                    first, off, more = at >> 20, at >> 10 & 1023, at & 1023
                    ctx = text[first : first + more + length]
                    ch = int.from_bytes(hashlib.blake2b(ctx + off.to_bytes(2, "big"), digest_size=8).digest(), "big", signed=True)
                    for column, value in zip(out, (g, ch, k, k2, at, None if (g, ch) in sent else ctx)):
                        column.append(value)
                    sent.add((g, ch))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["g", "ch", "k", "k2", "at", "ctx"])

    return texts.mapInArrow(run, "g long, ch long, k long, k2 int, at long, ctx binary")


def _sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """``g, ch, low, high``: repeated strings of contexts or of pieces (g, owner, base, ctx), as ranges of their owners' numbers; rows of one g come
    together, in order. Rows whose base is -1 are compared with the others, but not told."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        data, begin, _ = _laid([h[4] for h in held])
        strings = np.array([len(h[4]) for h in held]) - length + 1
        row = np.repeat(np.arange(len(held), dtype=np.int32), strings)
        nth = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(strings) - strings).astype(np.int32), strings)
        group = np.cumsum([i > 0 and held[i][0] != held[i - 1][0] for i in range(len(held))])
        base = np.array([h[3] for h in held], np.int64)
        found = repeated(Prefixes(data), begin[row] + nth, group.astype(np.int32)[row], length) & (base >= 0)[row]
        edge = np.diff(np.concatenate(([0], np.where(found, row + 1, 0), [0])))
        start, end = np.flatnonzero((edge != 0)[:-1] & found), np.flatnonzero((edge != 0)[1:] & found)
        columns = ([h[1] for h in held], [h[2] for h in held])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(c, np.int64)[row[start]]) for c in columns] + [pa.array(base[row[start]] + nth[k]) for k in (start, end)], ["g", "ch", "low", "high"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("g", "of", "ch", "base", "ctx"))):
                if size >= _SLICE and item[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(item)
                size += len(item[4])
        if held:
            yield solve(held)

    told = rows.select("g", F.col("owner.g").alias("of"), "owner.ch", "base", "ctx")
    return told.mapInArrow(run, "g long, ch long, low long, high long")


def _pieces(rows: DataFrame, length: int, step: int) -> DataFrame:
    """``g, sh, n, owner, base, off, ctx``: ``rows`` (the same columns) cut into pieces of up to ``step`` strings at neighbouring distances from the anchor.

    Equal strings have their anchor at the same distance, so they lie in pieces of the same distances, and both hold the core: the bytes that
    all strings of these distances have in common. A new ``g`` stands for the old one, distances and core. ``sh`` is a hash of the bytes of the
    piece and of the anchor's place: equal pieces have equal ``sh``. ``base`` is the number of the piece's first string in its owner.
    """
    last = F.octet_length("ctx").cast("long") - length
    rows = rows.withColumn("last", last)
    rows = rows.select("g", "n", "owner", "base", "off", "last", "ctx", F.explode(F.expr(f"sequence((off - last) div {step}, off div {step})")).alias("piece"))
    start = F.greatest(F.lit(0), F.col("off") - (F.col("piece") * step + step - 1)).cast("int")
    end = F.least(F.col("last"), F.col("off") - F.col("piece") * step).cast("int")
    core = F.substring("ctx", (F.col("off") - F.col("piece") * step + 1).cast("int"), F.lit(length - step + 1))
    rows = rows.select(F.xxhash64("g", "piece", core).alias("g"), "n", "owner", "base", "off", start.alias("start"), end.alias("end"), "ctx")
    sub = F.substring("ctx", F.col("start") + 1, F.col("end") - F.col("start") + length)
    rows = rows.select("g", "n", "owner", (F.col("base") + F.col("start")).alias("base"), (F.col("off") - F.col("start")).alias("off"), sub.alias("ctx"))
    digest = F.unhex(F.substring(F.sha2(F.concat("ctx", F.lit("/").cast("binary"), F.col("off").cast("string").cast("binary")), 256), 1, 32))
    return rows.select("g", digest.alias("sh"), "n", "owner", "base", "off", "ctx")


def _classes(pieces: DataFrame) -> DataFrame:
    """Equal pieces as one row of the same columns; ``n`` says how many contexts hold it, owner and base are meant where that is one."""
    firsts = [F.first(c).alias(c) for c in ("owner", "base", "off", "ctx")]
    return written(pieces.groupBy("g", "sh").agg(F.sum("n").alias("n"), *firsts), "suffix-classes")


def _open_sizes(classes: DataFrame) -> DataFrame:
    """``g, m``: how many different ones there are, where there are several and one of them occurs once."""
    sizes = classes.groupBy("g").agg(F.count("*").alias("m"), F.max((F.col("n") == 1).cast("int")).alias("open"))
    return written(sizes.where("m > 1 AND open = 1").drop("open"), "suffix-sizes")


def _whole(rows: DataFrame, length: int) -> DataFrame:
    """``g, ch, low, high`` of all strings of ``rows``."""
    last = F.octet_length("ctx").cast("long") - length
    return rows.select("owner.g", "owner.ch", F.col("base").alias("low"), (F.col("base") + last).alias("high"))


def _joined(ranges: Column) -> Column:
    """An array of ranges (low, high) in order, those that meet as one."""

    def take(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], r["high"]).alias("high"))
        meets = (F.size(done) > 0) & (last["high"] + 1 >= r["low"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<low:bigint,high:bigint>>"), take)


def _repeated_ranges(cut: DataFrame, length: int, crowd: int) -> DataFrame:
    """``g, ch, ranges``: the numbers of the repeated strings of every context that has some, as ranges (low, high) in order."""
    off = F.first(F.expr("shiftright(at, 10) & 1023")).alias("off")
    contexts = written(cut.groupBy("g", "ch").agg(F.count("*").alias("n"), off, F.first("ctx", ignorenulls=True).alias("ctx")), "suffix-contexts")
    level = contexts.withColumns({"sh": F.col("ch"), "owner": F.struct("g", "ch"), "base": F.lit(0).cast("long")})
    ranges = _whole(level.where("n > 1"), length)
    steps = sorted({max(1, length // 12), max(1, length // 48), 1})
    base = F.when(F.col("n") == 1, F.col("base")).otherwise(-1).alias("base")
    few = None
    while True:
        sizes = _open_sizes(level)
        several = level.join(sizes, "g")
        rows = several.where(F.col("m") <= crowd).select("g", "owner", base, "ctx")
        few = few.union(rows) if few is not None else rows
        if not steps or sizes.where(F.col("m") > crowd).isEmpty():
            break
        pieces = written(_pieces(several.where(F.col("m") > crowd), length, steps.pop()), "suffix-pieces")
        level = _classes(pieces)
        ranges = ranges.union(_whole(pieces.where("n = 1").join(level.where("n > 1").select("g", "sh"), ["g", "sh"], "left_semi"), length))
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.union(_sorted_groups(few.repartition(parts, "g").sortWithinPartitions("g"), length))
    return ranges.groupBy("g", "ch").agg(_joined(F.collect_list(F.struct("low", "high"))).alias("ranges"))


def repeated_spans(docs: DataFrame, length: int, gram: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Every distinct text (k, k2, text), and its repeated spans (k, k2, spans array<struct<start, end>>), unmerged."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _distinct_texts(docs, parts)
    found = _anchor_rows(texts, length, gram)
    again = found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    marks = found.join(again.hint("shuffle_hash"), "g").groupBy("k", "k2").agg(F.collect_list(F.struct("g", "at")).alias("marks"))
    marked = texts.join(marks.withColumnRenamed("k2", "own"), "k").where("k2 = own").select("k", "k2", "text", "marks")
    cut = written(_cut_contexts(marked, length), "suffix-anchors", _BATCH)
    # One row a context: its ranges stay together, however many there are and however often the context occurs.
    held = cut.drop("ctx").join(_repeated_ranges(cut, length, crowd), ["g", "ch"])
    first = F.expr("at div 1048576")
    spans = F.transform("ranges", lambda r: F.struct((first + r["low"]).alias("start"), (first + r["high"] + length).alias("end")))
    return texts, held.select("k", "k2", spans.alias("spans")).groupBy("k", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds two hashes of the text, together its key, and its number of bytes; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"text": text}).withColumns({"k": F.xxhash64("text"), "k2": F.hash("text"), "n_bytes": F.octet_length("text").cast("long")})


def cut_texts(docs: DataFrame, length: int = 200, gram: int = 64, crowd: int = 256) -> DataFrame:
    """``k, k2, n_removed, n_spans, kept binary, kept_sha256`` for every distinct text of ``docs`` (keyed) that has something to lose."""
    texts, spans = repeated_spans(docs, length, gram, crowd)
    copies = docs.groupBy("k", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    whole = copies.select("k", "k2", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    told = spans.select("k", "k2", F.lit(False).alias("whole"), "spans").union(whole)
    told = told.groupBy("k", "k2").agg(F.max("whole").alias("whole"), F.first("spans", ignorenulls=True).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, k2, text, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("k", "k2")), _bytes(batch), batch.column("whole").to_pylist(), batch.column("spans")):
                merged: list[list[int]] = []
                for start, end in [(0, len(text))] if whole and len(text) >= length else sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                edges = [0, *(x for span in merged for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k]), pa.array([k2], pa.int32()), pa.array([len(text) - len(kept)]), pa.array([len(merged)]),
                        pa.array([kept], pa.binary()), pa.array([hashlib.sha256(kept).hexdigest()]),
                    ],
                    ["k", "k2", "n_removed", "n_spans", "kept", "kept_sha256"],
                )

    joined = texts.join(told.withColumnRenamed("k2", "own"), "k").where("k2 = own").select("k", "k2", "text", "whole", "spans")
    return joined.mapInArrow(run, "k long, k2 int, n_removed long, n_spans long, kept binary, kept_sha256 string").where("n_removed > 0")


def deduplicated(docs: DataFrame, length: int = 200, gram: int = 64, crowd: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` (doc_id, text).

    Each byte covered by a string of ``length`` bytes that also starts elsewhere, in the same or another row, is removed, all occurrences
    alike; strings are judged on the input and never cross documents. Null and empty texts have nothing to lose; repeated
    rows lose everything if they are long enough; null ids are kept; no rows give no rows.
    """
    rows = keyed(docs.select("doc_id", "text"))
    plain = rows.select("doc_id", "k", "k2", "n_bytes", F.sha2("text", 256).alias("own"))
    cut = cut_texts(rows, length, gram, crowd).drop("kept")
    none = F.lit(0).cast("long")
    return plain.join(cut, ["k", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 64, crowd: int = 256) -> DataFrame:
    """``docs`` (all columns) with repeated strings cut from ``text``; characters that lose a part of their bytes go, ``n_chars`` follows.

    Every row stays, also with nothing left of its text. Null texts that lose nothing stay null.
    """
    rows = keyed(docs.withColumn("given", F.col("text")))
    cut = cut_texts(rows.select("k", "k2", "text"), length, gram, crowd).select("k", "k2", F.try_validate_utf8(F.col("kept").cast("string")).alias("valid"), "kept")
    mended = F.coalesce("valid", F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit("")))
    joined = rows.join(cut.select("k", "k2", mended.alias("mended")), ["k", "k2"], "left")
    text = F.coalesce("mended", "given")
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("mended").isNull(), F.col("n_chars")).otherwise(F.length("mended")))
    return joined.withColumn("text", text).select(*docs.columns)
