"""Phrases whose words keep together, found by dynamic itemset counting over cyclic scans of shards.

Documents are dealt into shards, which are scanned in turn, again and again. Words are counted from the first step on. After each step a phrase
that has reached the threshold opens the next length: a longer phrase is counted from the step after both its subphrases (all but
its last word, all but its first) have reached it, and until it has seen every shard once. So lengths interleave, and a step counts
words, pairs and triples at once.

Counts are rows of key (60 bits of hash, 4 of length) and number, summed per task before they are shuffled; the state of a step is one
table of counted phrases, from which complete ones below the threshold are dropped. Tasks learn which phrases are open from tables of fixed
size: for each slot of a hash the first and the last step at which a phrase of that slot reached the threshold. Slots and
keys that phrases share open or keep too many of them, never too few. A last scan therefore counts the kept phrases by their words, and
everything after that is exact, in columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from docgauge.llm.common import discarded, written
from docgauge.llm.wordhash import mixed

#: Characters that a task takes apart at a time, and counted phrases that it holds before it merges them: these bound its memory.
_CHUNK = 500_000
_HELD = 1_000_000
_LENGTH_BITS = 4
_NEVER = 255
_BLOCK = 1 << 16
_JOBS = 8
#: 0 for bytes of words, 1 for blanks, 2 for what ends a piece.
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t")] = 1
_KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
#: A-Z in lower case, and a tab as the space that words are joined by.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9] = 32
_BASES = (0xA24BAED4963EE407 | 1, 0xC2B2AE3D27D4EB4F | 1)


_KNOWN_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n at least of ``base`` modulo 2^64; a worker keeps those of an ordinary chunk."""
    known = _KNOWN_POWERS.get(base)
    if known is None or len(known) <= n:
        out = np.full(max(n, _CHUNK) + 1, base, np.uint64)
        out[0] = 1
        known = np.multiply.accumulate(out, out=out)
        if n <= 2 * _CHUNK:
            _KNOWN_POWERS[base] = known
    return known


@dataclass
class Words:
    """The words of some texts, one after another: their bytes, places, pieces and texts."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    text: np.ndarray

    def hashes(self, seeds: np.ndarray, base: int) -> np.ndarray:
        """A hash of every word and of the seed of its text."""
        powers, back = _powers(base, len(self.data)), _powers(pow(base, -1, 1 << 64), len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * powers[: len(self.data)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.begin]) * back[self.begin] + (self.end - self.begin).astype(np.uint64) + seeds[self.text])

    def phrases(self, words: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: keys of the runs of words from every place, and whether such a run lies within one piece."""
        h = np.zeros(len(words), np.uint64)
        for size in range(1, longest + 1):
            n = max(0, len(words) - size + 1)
            h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + words[size - 1 : size - 1 + n]
            keys = (mixed(h + np.uint64(size)) & ~np.uint64((1 << _LENGTH_BITS) - 1)) | np.uint64(size)
            yield size, keys, self.piece[:n] == self.piece[size - 1 : size - 1 + n]

    def told(self, at: np.ndarray, size: int) -> list[bytes]:
        """The runs of ``size`` words from each place, joined by single spaces; most stand so in the text."""
        raw = self.data.tobytes()
        begin, end = self.begin[at], self.end[at + size - 1]
        letters = np.concatenate(([0], np.cumsum(self.end - self.begin)))
        spaced = end - begin == letters[at + size] - letters[at] + size - 1
        return [
            raw[b:e] if plain else b" ".join([raw[self.begin[i] : self.end[i]] for i in range(k, k + size)])
            for k, b, e, plain in zip(at.tolist(), begin.tolist(), end.tolist(), spaced.tolist())
        ]


def words_of(texts: list[str | None]) -> Words:
    encoded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    data = _LOWER[data]
    kinds = _KINDS[data]
    edges = np.diff((kinds == 0).astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    ends = np.cumsum(np.array([len(t) + 1 for t in encoded], np.int64))
    return Words(data, begin, end, np.cumsum(kinds == 2)[begin], np.searchsorted(ends, begin, "right"))


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words]]:
    """Languages and words of some texts at a time."""
    for batch in batches:
        at, texts = 0, batch.column("text")
        langs = batch.column("lang").to_pylist()
        while at < batch.num_rows:
            some: list[str | None] = []
            size = 0
            while at + len(some) < batch.num_rows and size < _CHUNK:
                some.append(texts[at + len(some)].as_py())
                size += len(some[-1] or "")
            yield langs[at : at + len(some)], words_of(some)
            at += len(some)


def _slots(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(_LENGTH_BITS)) & np.uint64(n - 1)).astype(np.int64)


def _gathered(blocks: DataFrame) -> Iterator[Row]:
    """Rows of ``blocks``, read by few jobs: one for every partition of a shuffle would take longer than the work in them."""
    table = written(blocks, "phrases-blocks")
    yield from table.coalesce(_JOBS).toLocalIterator()
    discarded(table)


def _blocks(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest ``value`` of the ``key``s of each of ``n`` slots (255 and 0 where there is none), gathered block by block."""
    block = F.expr(f"CAST(shiftright(key, {_LENGTH_BITS}) & {n - 1} AS LONG)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            slots, values = batch.column("slot").to_numpy(), batch.column("value").to_numpy().astype(np.uint8)
            for b in np.unique(slots // _BLOCK).tolist():
                low, high = made.setdefault(b, (np.full(_BLOCK, _NEVER, np.uint8), np.zeros(_BLOCK, np.uint8)))
                mine = slots // _BLOCK == b
                np.minimum.at(low, slots[mine] % _BLOCK, values[mine])
                np.maximum.at(high, slots[mine] % _BLOCK, values[mine])
        columns = [pa.array(list(made), pa.int64())] + [pa.array([pa.compress(v[i].tobytes(), codec="zstd", asbytes=True) for v in made.values()], pa.binary()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "low", "high"])

    dealt = rows.select(block.alias("slot"), "value").repartition(F.expr(f"slot div {_BLOCK}"))
    low, high = np.full(n, _NEVER, np.uint8), np.zeros(n, np.uint8)
    for row in _gathered(dealt.mapInArrow(run, "block long, low binary, high binary")):
        at = slice(row["block"] * _BLOCK, (row["block"] + 1) * _BLOCK)
        low[at], high[at] = (np.frombuffer(pa.decompress(bytes(row[c]), _BLOCK, codec="zstd", asbytes=True), np.uint8) for c in ("low", "high"))
    return low, high


def _sized(n: int, most: int) -> int:
    """Slots for n keys: a power of two of at least 16 times as many, one block at least and ``most`` at most."""
    return min(most, max(_BLOCK, 1 << (16 * n).bit_length()))


def _summed(keys: np.ndarray, counts: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    if not len(first):
        return keys, counts, until
    return keys[first], np.add.reduceat(counts[order], first), until[order][first]


def _counted(shard: DataFrame, step: int, shards: int, longest: int, tables: dict) -> DataFrame:
    """``key, c, until``: open phrases of a shard and how often a task saw them, and the step in which their cycle ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {size: (low.value, high.value) for size, (low, high) in tables.items()}

        def opened(words: Words, langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            h = words.hashes(np.array([_seed(x) for x in langs], np.uint64), _BASES[0])
            first = last = None
            for size, keys, whole in words.phrases(h, longest):
                if size == 1:
                    if step < shards:
                        yield keys, np.full(len(keys), shards - 1, np.int64)
                else:
                    low, high = np.maximum(first[:-1], first[1:]), np.maximum(last[:-1], last[1:])
                    open_ = np.flatnonzero(whole & (low < step) & (high + shards >= step))
                    yield keys[open_], high[open_] + shards
                if size not in known:
                    return
                slots = _slots(keys, len(known[size][0]))
                first, last = (side[slots].astype(np.int64) for side in known[size])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged() -> tuple[np.ndarray, ...]:
            return _summed(*(np.concatenate([h[i] for h in held]) for i in range(3)))

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts, until = held[0]
            for at in range(0, len(keys), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part].view(np.int64)), pa.array(counts[part]), pa.array(until[part].astype(np.int32))], ["key", "c", "until"]
                )

        for langs, words in _chunks(batches):
            found = list(opened(words, langs))
            if found:
                keys, until = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                held.append(_summed(keys, np.ones(len(keys), np.int64), until.astype(np.int16)))
                size += len(held[-1][0])
            if size > _HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > _HELD // 2:
                    yield from out()
                    held, size = [], 0
        if held:
            held = [merged()]
            yield from out()

    return shard.mapInArrow(run, "key long, c long, until int")


def frequent(docs: DataFrame, longest: int, least: int, shards: int, most_slots: int) -> DataFrame:
    """``key``: the phrases of ``docs`` (lang, text, shard) that occur at least ``least`` times, by dynamic itemset counting."""
    spark = docs.sparkSession
    state, tables = None, {}
    length = F.col("key").bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))
    for step in range(longest * shards):
        shard = docs.where(F.col("shard") == step % shards).select("lang", "text")
        rows = _counted(shard, step, shards, longest, tables).withColumn("reach", F.lit(None).cast("int"))
        if state is not None:
            rows = rows.union(state)
        summed = rows.groupBy("key").agg(F.sum("c").alias("c"), F.max("until").alias("until"), F.min("reach").alias("reach"))
        reach = F.coalesce("reach", F.when(F.col("c") >= least, F.lit(step)))
        before, state = state, written(summed.where((F.col("c") >= least) | (F.col("until") > step)).select("key", "c", "until", reach.alias("reach")), "phrases-state")
        if before is not None:
            discarded(before)
        seen = state.where("reach IS NOT NULL")
        sizes = {r["size"]: (r["n"], r["last"]) for r in seen.groupBy(length.alias("size")).agg(F.count("*").alias("n"), F.max("reach").alias("last")).collect()}
        still = step < shards - 1 or not state.where(F.col("until") > step).isEmpty()
        if not still and not any(last == step for size, (_, last) in sizes.items() if size < longest):
            break
        for old in tables.values():
            for side in old:
                side.unpersist()
        tables = {}
        for size, (n, _) in sizes.items():
            if size < longest:
                found = _blocks(seen.where(length == size).select("key", F.col("reach").alias("value")), _sized(n, most_slots))
                tables[size] = tuple(spark.sparkContext.broadcast(side) for side in found)
    return state.where(F.col("c") >= least).select("key")


def _bitmap(keys: DataFrame, n: int) -> np.ndarray:
    """``n`` packed bits, set where ``keys`` have their slot, gathered block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.sort(batch.column("slot").to_numpy())
            blocks, starts = np.unique(slots // _BLOCK, return_index=True)
            for block, part in zip(blocks.tolist(), np.split(slots % _BLOCK, starts[1:])):
                made.setdefault(block, np.zeros(_BLOCK, bool))[part] = True
        blobs = [pa.compress(np.packbits(bits).tobytes(), codec="zstd", asbytes=True) for bits in made.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(blobs, pa.binary())], ["block", "bits"])

    slots = keys.select(F.expr(f"CAST(shiftright(key, {_LENGTH_BITS}) & {n - 1} AS LONG)").alias("slot")).distinct()
    out = np.zeros(n // 8, np.uint8)
    size = _BLOCK // 8
    for row in _gathered(slots.repartition(F.expr(f"slot div {_BLOCK}")).mapInArrow(run, "block long, bits binary")):
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(pa.decompress(bytes(row["bits"]), size, codec="zstd", asbytes=True), np.uint8)
    return out


def _recounted(docs: DataFrame, keys: DataFrame, longest: int, most_bits: int) -> DataFrame:
    """``lang, size, phrase, n``: exact counts, by their words, of the phrases whose keys are among ``keys`` (and of few others), and in
    rows of size 0 the number of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(keys, _sized(4 * keys.count(), most_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        n_slots = len(bits) * 8
        held: dict[tuple[str, int, bytes], int] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = iter(held.items())
            while part := list(islice(rows, 50_000)):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()),
                        pa.array([k[2].decode() for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64()),
                    ],
                    ["lang", "size", "phrase", "n"],
                )

        for langs, words in _chunks(batches):
            seeds = np.array([_seed(x) for x in langs], np.uint64)
            h, again = (words.hashes(seeds, base) for base in _BASES)
            every, times = np.unique(words.text, return_counts=True)
            for text, n in zip(every.tolist(), times.tolist()):
                held[langs[text], 0, b""] = held.get((langs[text], 0, b""), 0) + n
            second = words.phrases(again, longest)
            for size, keys, whole in words.phrases(h, longest):
                others = next(second)[1]
                slots = _slots(keys, n_slots)
                at = np.flatnonzero(whole & ((bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).astype(bool))
                order = at[np.argsort(keys[at])]
                first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
                times = np.diff(np.append(first, len(order)))
                if (others[order] != np.repeat(others[order[first]], times)).any():  # different phrases of one key
                    order = at[np.lexsort((others[at], keys[at]))]
                    first = np.flatnonzero((np.diff(keys[order], prepend=~keys[order[:1]]) != 0) | (np.diff(others[order], prepend=~others[order[:1]]) != 0))
                    times = np.diff(np.append(first, len(order)))
                places = order[first]
                for text, said, n in zip(words.text[places].tolist(), words.told(places, size), times.tolist()):
                    key = (langs[text], size, said)
                    held[key] = held.get(key, 0) + n
            if len(held) > 400_000:
                yield from out()
                held = {}
        yield from out()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, size int, phrase string, n long")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _part(first: int | Column, size: int | Column) -> Column:
    """``size`` words of the phrase from word ``first`` (from 1) on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def scored(counts: DataFrame, least: int) -> DataFrame:
    """``lang, size, phrase, a, l, r, score`` of every phrase of two or more words that occurs ``least`` times, by its lowest cut."""
    phrases = counts.where((F.col("size") > 1) & (F.col("n") >= least))
    cuts = phrases.select("lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    known = counts.where("size > 0").select("lang", "phrase", "n")
    cuts = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    cuts = cuts.withColumn("top", F.lit(1000000).cast("decimal(7,0)") * (a * a)).withColumn("bottom", l * r).withColumn("score", F.expr("top div bottom"))
    return cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "size", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, shards: int = 2,
    most_slots: int = 1 << 23, most_bits: int = 1 << 30, salts: int = 32,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` (at most 15) words, all numbers long.

    A phrase occurs ``a >= least`` times within pieces. Each way to cut it in two, into parts that occur l and r times, gives
    floor(1000000 a a / (l r)); the lowest counts, of equal ones that with the shorter first part. Phrases inside a longer one that occurs in at
    least ``cover`` percent of their places are dropped. Order: score and a descending, then the phrase by its bytes. ``n``: all words of the
    language. A null text is empty, a null language ``und``; a repeated row counts again; without phrases there are no rows. Other columns are
    left out. ``shards``: parts of the corpus scanned in turn; ``most_slots`` (bytes) and ``most_bits`` bound the tables that tasks are given:
    beyond a sixteenth and a sixty-fourth of them in phrases, tasks count more phrases that come to nothing, with the same result.
    """
    shard = F.pmod(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), F.lit(shards))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text", shard.alias("shard"))
    keys = frequent(rows, longest, least, shards, most_slots)
    counts = written(_recounted(rows, keys, longest, most_bits).where((F.col("n") >= least) | (F.col("size") == 0)), "phrases-counts")
    phrases = written(scored(counts, least), "phrases-scored")
    sizes = F.sequence(F.lit(2), F.col("size") - 1)
    inside = phrases.where("size > 2").select("lang", "size", "phrase", "a", F.explode(sizes).alias("of"))
    inside = inside.select("lang", "phrase", "a", "of", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("of") + 1)).alias("at"))
    inside = inside.groupBy("lang", _part(F.col("at"), F.col("of")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sums = counts.where("size = 0").select("lang", "n")
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
