"""Mixing sources to target weights: packed blocks, multinomial draws per output shard, index permutations.

Columns and SQL functions only. The words of each source form one stream (documents by a hash bucket and then by id), cut
into blocks of ``block`` words. A source with target of W words gives every block W div size times and then the first blocks of one
more pseudorandom order until W words are reached, the last block cut short. Output slots are dealt to shards of
``shard_slots``; each shard draws its counts of sources from a multinomial over the targets. Where all draws together exceed a
source's slots, its last ones go to sources that were drawn too rarely, so every source gives exactly the words of its target.
The i-th slot of a source maps to a block through a permutation of the source's block numbers, and blocks join by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docgauge.llm.common import BLANK, written

_ROUNDS = 24


@dataclass(frozen=True)
class Mix:
    """``sources``: one row per source; ``slots``: one per output slot; ``segments``: the pieces of documents in blocks; ``docs``: sizes."""

    sources: DataFrame
    slots: DataFrame
    segments: DataFrame
    docs: DataFrame


def word_count(text: Column) -> Column:
    """Number of words, as the count of their first characters: no array of words is made, however long the text."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+|([^{BLANK}])[^{BLANK}]*", "$1")).cast("long")


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 by swap-or-not rounds, or its inverse: each round swaps x with (k - x) mod n or not."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(F.lit("round"), r, *key) - at, n)
        swap = F.pmod(F.xxhash64(F.lit("swap"), r, F.greatest(at, partner), *key), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(at)

    order = range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS)
    return F.aggregate(F.array(*[F.lit(r) for r in order]), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: int) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): shares of ``share`` x all sizes by weight, none above ``ceiling`` x its size.

    One task sees one row per source. Sources in order of code points, null last, take the weights in turn. In order of
    ceiling per weight, a source is at its ceiling if its weighted part of what the earlier ones leave reaches it.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns(
        {
            "weight": F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")),
            "most": F.col("source_size") * ceiling,
        }
    )
    everyone, earlier = W.partitionBy(), W.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    level = left / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    levelled = ranked.withColumn("level", level)
    below = F.max(F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("level"))).over(everyone)
    return levelled.withColumn("level", below).select(
        "sid", "source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most"))).alias("target")
    )


def _slot_plan(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds to each source: words to take, blocks, whole rounds over them, words and slots of the last round, slots in all."""
    size, words = F.col("source_size"), F.round("target").cast("long")
    plan = targets.withColumns({"words": words, "n_blocks": F.ceil(size / block)}).where("words > 0")
    plan = plan.withColumns({"rounds": F.expr("words div source_size"), "rest": F.col("words") % size, "short": F.col("n_blocks") * block - size})
    plan = plan.withColumn("short_at", permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("rounds"), back=True))
    plain = F.ceil(F.col("rest") / block)
    last = F.when(F.col("short_at") < plain, F.ceil((F.col("rest") + F.col("short")) / block)).otherwise(plain)
    return plan.withColumn("n_slots", F.col("rounds") * F.col("n_blocks") + last)


def _drawn(plan: DataFrame, total: int, shard_slots: int, seed: int, partitions: int) -> DataFrame:
    """``shard, sid, n``: slots of each source in each shard, drawn and then set right to the planned totals."""
    spark, cells = plan.sparkSession, 1024
    width = -(-total // cells)
    ends = plan.withColumn("hi", F.sum("n_slots").over(W.orderBy("sid")))
    parts = ends.select("sid", (F.col("hi") - F.col("n_slots")).alias("lo"), "hi")
    parts = parts.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    draw = F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(total))
    draws = spark.range(0, total, 1, partitions).select(F.expr(f"id div {shard_slots}").alias("shard"), draw.alias("u"))
    draws = draws.withColumn("cell", F.expr(f"u div {width}"))
    counts = draws.join(parts, "cell").where("lo <= u and u < hi").groupBy("shard", "sid").agg(F.count("*").alias("n"))
    counts = written(counts, "mix-draws")
    before = F.sum("n").over(W.partitionBy("sid").orderBy("shard")) - F.col("n")
    kept = counts.join(plan.select("sid", "n_slots"), "sid").withColumn("keep", F.greatest(F.lit(0), F.least("n", F.col("n_slots") - before)))
    free = kept.groupBy("shard").agg(F.sum(F.col("n") - F.col("keep")).alias("k")).where("k > 0")
    short = plan.join(counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left")
    short = short.select("sid", (F.col("n_slots") - F.coalesce("drawn", F.lit(0))).alias("k")).where("k > 0")

    def numbered(df: DataFrame, key: str) -> DataFrame:
        ends = df.withColumn("end", F.sum("k").over(W.orderBy(key)))
        return ends.select(key, F.explode(F.sequence(F.col("end") - F.col("k"), F.col("end") - 1)).alias("turn"))

    moved = numbered(free, "shard").join(numbered(short, "sid"), "turn").select("shard", "sid", F.lit(1).cast("long").alias("n"))
    dealt = kept.select("shard", "sid", F.col("keep").alias("n")).union(moved)
    return dealt.groupBy("shard", "sid").agg(F.sum("n").alias("n")).where("n > 0")


def _slots(plan: DataFrame, counts: DataFrame, block: int, seed: int) -> DataFrame:
    """``shard, sid, nth, round, block, take``: every output slot with its block and how many of the block's words it takes."""
    end = F.sum("n").over(W.partitionBy("sid").orderBy("shard"))
    nth = counts.withColumn("end", end).select("shard", "sid", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("nth"))
    slots = nth.join(plan, "sid").withColumns({"round": F.expr("nth div n_blocks"), "at": F.col("nth") % F.col("n_blocks")})
    slots = slots.withColumn("block", permuted(F.col("at"), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("round")))
    whole = F.lit(block) - F.when(F.col("block") == F.col("n_blocks") - 1, F.col("short")).otherwise(0)
    begun = F.col("at") * block - F.when(F.col("at") > F.col("short_at"), F.col("short")).otherwise(0)
    take = F.when(F.col("round") < F.col("rounds"), whole).otherwise(F.least(whole, F.col("rest") - begun))
    return slots.select("shard", "sid", "nth", "round", "block", take.alias("take"), (take == whole).alias("whole"))


def _segments(sized: DataFrame, block: int, buckets: int) -> DataFrame:
    """``sid, block, doc_id, start, size, first, last``: where each document lies in its source's stream, by block.

    Running sums in two steps, over hash buckets of a source and inside each, so that no task holds a whole source.
    """
    salted = sized.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = salted.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = sums.withColumn("offset", F.sum("bucket_size").over(W.partitionBy("sid").orderBy("bucket")) - F.col("bucket_size"))
    inside = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    placed = salted.withColumn("start", inside - F.col("size")).join(offsets.drop("bucket_size"), ["sid", "bucket"])
    placed = placed.select("sid", "doc_id", "size", (F.col("start") + F.col("offset")).alias("start"))
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    first = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
    last = F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block)
    return cut.select("sid", "block", "doc_id", "start", "size", first.alias("first"), last.alias("last"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    ceiling: int = 2,
    block: int = 512,
    shard_slots: int = 4096,
    buckets: int = 4096,
    seed: int = 17,
) -> Mix:
    """Plans the mix of ``docs`` (doc_id, text, source; other columns are left out).

    A null text has no words, a null source is a source of its own, null and repeated ids are documents like others. Empty
    input gives empty tables. The same rows give the same mix, in whatever order or partitions they come.
    """
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, ceiling), "mix-targets")
    plan = written(_slot_plan(targets, block, seed), "mix-plan")
    total = plan.agg(F.sum("n_slots")).first()[0] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-total // 1_000_000))
    placed = sized.join(targets.select(F.col("source").alias("of"), "sid"), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "sid")
    if total:
        slots = _slots(plan, _drawn(plan, total, shard_slots, seed, partitions), block, seed)
    else:
        slots = spark.createDataFrame([], "shard long, sid int, nth long, round long, block long, take long, whole boolean")
    return Mix(targets, slots, _segments(placed, block, buckets), placed)


def taken_words(mix: Mix) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken``: one row per document of the input, with the words the mix takes of it."""
    uses = mix.slots.groupBy("sid", "block").agg(
        F.count(F.when(F.col("whole"), 1)).alias("full"), F.coalesce(F.max(F.when(~F.col("whole"), F.col("take"))), F.lit(0)).alias("cut")
    )
    part = (F.col("last") - F.col("first")) * F.col("full") + F.greatest(F.lit(0), F.least("last", "cut") - F.col("first"))
    used = mix.segments.join(uses, ["sid", "block"], "left")
    taken = used.groupBy("sid", "start", "doc_id", "size").agg(F.sum(F.coalesce(part, F.lit(0))).alias("taken"))
    empty = mix.docs.where("size = 0").select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    rows = taken.select("sid", "doc_id", "size", "taken").union(empty)
    return rows.join(mix.sources, "sid").select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, mix: Mix, block: int = 512) -> DataFrame:
    """``shard, sid, nth, text``: the mixed words themselves, one row per output slot, words joined by single spaces."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[^{BLANK}]+"), F.lit(0))
    of = mix.sources.select(F.col("source").alias("of"), "sid")
    texts = docs.join(of, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "sid", words.alias("words"))
    copies = W.partitionBy("sid", "doc_id", "size")
    texts = texts.withColumn("size", F.size("words").cast("long")).withColumn("copy", F.row_number().over(copies.orderBy(F.xxhash64("words"))))
    starts = mix.segments.select("sid", "doc_id", "size", "start").distinct().withColumn("copy", F.row_number().over(copies.orderBy("start")))
    texts = texts.withColumn("doc_id", F.struct("doc_id"))  # a null id must meet itself
    starts = starts.withColumn("doc_id", F.struct("doc_id"))
    placed = starts.join(texts, ["sid", "doc_id", "size", "copy"]).select("sid", "start", "words")
    pieces = mix.segments.join(placed, ["sid", "start"]).join(mix.slots.select("shard", "sid", "nth", "block", "take"), ["sid", "block"])
    skipped = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    length = F.least("last", "take") - F.col("first")
    piece = F.array_join(F.slice("words", (skipped + 1).cast("int"), length.cast("int")), " ")
    pieces = pieces.where("take > first").select("shard", "sid", "nth", F.struct("first", piece.alias("text")).alias("piece"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda p: p["text"]), " ")
    return pieces.groupBy("shard", "sid", "nth").agg(joined.alias("text"))
