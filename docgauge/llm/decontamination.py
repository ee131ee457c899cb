"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` words that a document shares with a benchmark item (seeds) are joined by hash. Each pair with enough seeds
is tiled: the longest run of words that both have, not yet marked in either, is found by Karp-Rabin hashes and
marked, again and again, down to ``least`` words. A document is contaminated by an item if tiles cover ``threshold`` of the item's words, in
whatever order the passages lie.

Documents without any seed are left out early: a bitmap of fixed size (``bitmap_bits``) says which hashes may be seeds. It only spares
rows of the join, which decides; a larger benchmark lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docgauge.llm.common import written
from docgauge.llm.wordhash import runs, word_hashes

_SLICE = 1 << 20


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, words) of two arrays of word hashes; the longest first, none of them overlapping."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while True:
        found = _longest(doc, item, free_doc, free_item, size)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:  # look for the long ones first
            size = longest
            continue
        for n, i, d in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[i : i + n].all() and free_doc[d : d + n].all():
                free_item[i : i + n] = free_doc[d : d + n] = False
                tiles.append((i, d, n))
        if not found or size > least:
            if size == least:
                return tiles
            if not any(n > size for n, _, _ in found):
                size = max(least, size // 2)
        # else: matches cut short by others may still hold runs of this size: search again


def _longest(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal free matches of at least ``size`` words as (words, place in item, place in doc), by hashes of all free windows of that size."""
    if len(item) < size or len(doc) < size:
        return []
    hashes = [runs(x, np.zeros(len(x), np.int64), size)[0] for x in (doc, item)]
    whole = [np.convolve(f, np.ones(size, int), "valid") == size for f in (free_doc, free_item)]
    wanted = np.flatnonzero(whole[1])
    places: dict[int, list[int]] = {}
    for d in np.flatnonzero(whole[0] & np.isin(hashes[0], hashes[1][wanted])).tolist():
        places.setdefault(int(hashes[0][d]), []).append(d)
    found = []
    reached: dict[int, int] = {}  # how far the item is matched on each diagonal
    for i in wanted.tolist():
        for d in places.get(int(hashes[1][i]), ()):
            if reached.get(d - i, -1) >= i + size or not np.array_equal(doc[d : d + size], item[i : i + size]):
                continue
            n = size
            while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_item[i + n] and free_doc[d + n]:
                n += 1
            reached[d - i] = i + n
            found.append((n, i, d))
    return found


def _seeds(items: DataFrame, least: int) -> DataFrame:
    """``seed, item_id, n``: how often each run of words lies in each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, at = runs(*(both := word_hashes(batch.column("text").to_pylist())), least)
            own = batch.column("item_id").take(pa.array(both[1][at]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), own], ["seed", "item_id"])

    rows = items.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(run, "seed long, item_id long")
    return rows.groupBy("seed", "item_id").agg(F.count("*").alias("n"))


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which values the low bits of the seeds take: a bitmap of 2^bits bits, however many seeds there are."""
    low = F.col("seed").bitwiseAND((1 << bits) - 1)
    words = seeds.select(F.shiftright(low, 5).alias("w"), F.expr("shiftleft(1L, cast(seed & 31 as int))").alias("b"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most 2^(bits - 5) rows
        out[row.w] = row.b
    return out


def _seeded(docs: DataFrame, bitmap: np.ndarray, bits: int, least: int) -> DataFrame:
    """Adds ``seeds``: the distinct runs of words of each document that may be seeds; documents without any are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = held = 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held < _SLICE and i + 1 < len(texts):
                    continue
                words, of = word_hashes(texts[at : i + 1])
                hashes, place = runs(words, of, least)
                low = hashes & mask
                hit = (bitmap[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
                seeds, own = hashes[hit].view(np.int64), of[place[hit]]
                rows = np.unique(own)
                if len(rows):
                    found = [np.unique(seeds[own == r]) for r in rows]
                    kept = pa.RecordBatch.from_struct_array(batch.slice(at, i + 1 - at).to_struct_array().take(pa.array(rows)))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "key", "seeds"])
                at, held = i + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "key").mapInArrow(run, f"doc_id {kind}, text string, key long, seeds array<long>")


def _tiled(pairs: DataFrame, least: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, of = word_hashes([row["text"], row["item"]])
                item = words[of == 1]
                tiles = greedy_tiles(words[of == 0], item, least)
                covered = sum(n for _, _, n in tiles)
                if covered and covered >= threshold * len(item):
                    order = [d for _, d, _ in sorted(tiles)]
                    spans = [{"item_word": i, "doc_word": d, "words": n} for i, d, n in sorted(tiles)]
                    yield pa.RecordBatch.from_pylist(
                        [{"doc_id": row["doc_id"], "key": row["key"], "item_id": row["item_id"], "coverage": covered / len(item), "reordered": order != sorted(order), "tiles": spans}],
                        batch_schema,
                    )

    tile = pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
    batch_schema = pa.schema(
        [("doc_id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("reordered", pa.bool_()), ("tiles", pa.list_(tile))]
    )
    return pairs.mapInArrow(
        run, "doc_id long, key long, item_id long, coverage double, reordered boolean, tiles array<struct<item_word: int, doc_word: int, words: int>>"
    )


def text_key(docs: DataFrame) -> DataFrame:
    """Adds ``key``, a hash of id and text that stands for the row, also where the id is null."""
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, least: int = 5, bitmap_bits: int = 24) -> DataFrame:
    """``doc_id, key, item_id, coverage, reordered, tiles``: pairs of a document and a benchmark item that it holds.

    Needs ``doc_id, text`` (``key`` by ``text_key``, added where missing) and ``item_id, text``. Null and empty texts match nothing, nor
    do items of fewer than ``least`` words or with a null id. Repeated documents give repeated rows, repeated items with one id are one.
    No documents or no items give no rows. Other columns are left out.
    """
    docs = docs if "key" in docs.columns else text_key(docs)
    items = items.groupBy("item_id").agg(F.max("text").alias("text"))
    seeds = written(_seeds(items, least), "seeds")
    hit = written(_seeded(docs, _bitmap(seeds, bitmap_bits), bitmap_bits, least), "seeded")
    shared = hit.select("key", F.explode("seeds").alias("seed")).distinct().join(seeds, "seed")
    # tiles that cover the threshold hold at least one seed for every ``least`` words of it
    counted = shared.groupBy("key", "item_id").agg(F.sum("n").alias("n"))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    sized = items.select("item_id", F.col("text").alias("item"), words.alias("words"))
    pairs = counted.join(sized, "item_id").where(F.col("n") * least >= F.col("words") * threshold).select("key", "item_id", "item")
    return _tiled(hit.select("doc_id", "key", "text").join(pairs, "key").select("doc_id", "key", "text", "item_id", "item"), least, threshold)


def clean(docs: DataFrame, items: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no benchmark item contaminates."""
    own = text_key(docs)
    found = contaminated(own.select("doc_id", "text", "key"), items, **bounds).select("key").distinct()
    return own.join(written(found, "contaminated"), "key", "left_anti").select(*docs.columns)
