"""Near copies by word shingles: min-hash bands find candidates, the Jaccard similarity of the whole shingle sets decides.

Two sets of similarity 0.8 differ in about 10 of 64 SimHash bits, where no segment of a fingerprint is left whole; the stage of the
pipeline therefore adds these links to those of ``simhash``. Sets meet in a bucket if all ``ROWS`` least hashes of a band agree: of
``BANDS`` bands at least one does so for 99.997 % of the pairs at 0.8, for more of those above.

No bucket writes all its pairs. Every member is first compared with the bucket's smallest id. Where this leaves buckets in more than one
component, their members are compared where they share rare shingles: of two sets of the wanted similarity, ordered by how often
their shingles occur, rarest first, the first few of the one hold one of the first few of the other (``rarest``). A passage that unlike
documents share is last in their order, so they do not meet. Those who meet at a shingle and are in different components are points of
one region of ``setjoin``, which joins those that can be similar to clusters, without writing their pairs, and compares the sets of a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docgauge.llm.common import grown, written
from docgauge.llm.graph import components
from docgauge.llm.setjoin import clustered, count_vectors, linked, tiled
from docgauge.llm.simhash import fold, links, shingle_hashes
from docgauge.llm.wordhash import mixed

BANDS, ROWS = 20, 4
_SEEDS = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_HELD = 300_000
#: Texts that come to a task at once.
_BATCH = 1_000
#: At most so many shingles are told apart as common; the others count as equally rare.
_COMMON = 1_000_000


def band_keys(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys (a row per document, a column per band) of documents, none empty, whose hashes lie one after another."""
    starts = np.cumsum(lengths) - lengths
    keys = np.zeros((len(lengths), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(mixed((hashes ^ _SEEDS[0, k]) * (_SEEDS[1, k] | np.uint64(1))), starts)
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(k))
    return keys


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp, size, digest, bands``: fingerprint, number and digest of the distinct shingles, and band keys (none without words)."""

    def made(ids: list, found: list[list[int]]) -> pa.RecordBatch:
        lengths = np.array([len(f) for f in found], np.int64)
        hashes = np.array([h for f in found for h in f], np.uint64)
        sets = [np.unique(part) for part in np.split(hashes, np.cumsum(lengths)[:-1])]
        bands = [[] for _ in ids]
        full = np.flatnonzero(lengths)
        if len(full):
            for i, keys in zip(full.tolist(), band_keys(hashes, lengths[full]).view(np.int64)):
                bands[i] = keys
        columns = [
            pa.array(ids, pa.int64()), pa.array(fold(hashes, lengths).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(bands, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "size", "digest", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            found: list[list[int]] = []
            held = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                found.append(shingle_hashes(text.as_py(), width))
                held += len(found[-1])
                if held > _HELD or len(ids) == 1024:
                    yield made(ids, found)
                    ids, found, held = [], [], 0
            if ids:
                yield made(ids, found)

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return wanted.mapInArrow(run, "doc_id long, fp long, size long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, shingles``: the distinct shingle hashes of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [np.unique(np.array(shingle_hashes(t.as_py(), width), np.uint64)).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, shingles array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``shingle_sets`` of the texts with these ids, which are written first, so that Spark knows their size when it chooses how to pick texts."""
    ids = written(ids.distinct(), "near-ids")
    return written(shingle_sets(docs.join(ids, "doc_id", "left_semi"), width), "near-sets", _BATCH)


def rarest(sets: DataFrame, least: float) -> DataFrame:
    """``doc_id, size, s, short``: the rarest shingles of every set, as many as the partners of ``least`` need to meet.

    Two sets of similarity ``least`` or more, the smaller of size n and the larger of size m, share at least 2 least / (1 + least) n and
    least * m shingles. So in one order of all shingles the first n - 2 least / (1 + least) n + 1 of the smaller set (``short``) and the
    first m - least * m + 1 of the larger one have one in common.
    """
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    rows = sets.select("doc_id", F.xxhash64("shingles").alias("tag"), F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("times")).where(F.col("times") > max(16, total // _COMMON))
    rows = rows.join(F.broadcast(written(common, "near-common")), "s", "left")
    ranked = rows.groupBy("doc_id", "tag", "size").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "s"))).alias("all"))
    many, few = (F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1 for share in (least, 2 * least / (1 + least)))
    first = ranked.select("doc_id", "size", few.alias("few"), F.posexplode(F.slice("all", F.lit(1), many.cast("int"))).alias("place", "one"))
    return first.select("doc_id", "size", F.col("one.s").alias("s"), (F.col("place") < F.col("few")).alias("short"))


def alike(docs: DataFrame, pairs: DataFrame, width: int, least: float, sets: DataFrame | None = None) -> DataFrame:
    """The rows of ``pairs`` (a, b: ids of ``docs``) whose whole texts have shingle sets of Jaccard similarity ``least`` or more.

    ``sets`` may give the shingle sets of these ids.
    """
    if sets is None:
        sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), width)
    rows = pairs.join(sets.toDF("b", "of_b"), "b").join(sets.toDF("a", "of_a"), "a")
    rows = rows.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return rows.where((F.col("both") > 0) & (F.col("both") >= least * (F.col("total") - F.col("both")))).select("a", "b")


def near_groups(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, component_id`` for every id of ``docs`` (doc_id, text; other columns are left out).

    Documents link if their shingle sets have a Jaccard similarity of ``least`` or more, or if their fingerprints differ in at most 3
    bits; the component is the smallest id that links lead to. Null and empty texts have the fingerprint 0 and link with each other. An id
    with several texts has the smallest of their components. No rows give no rows.
    """
    known = docs.where("doc_id IS NOT NULL")
    made = written(sketches(known, width), "near-sketches", _BATCH)
    nodes = made.groupBy("digest", "fp").agg(F.min("doc_id").alias("node"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    nodes = written(nodes, "near-nodes")
    tied = made.join(nodes.select("digest", "fp", "node"), ["digest", "fp"]).select("doc_id", "node")

    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    ends = links(prints.select("fp")).join(prints.toDF("a", "first_a"), "a").join(prints.toDF("b", "first_b"), "b")
    edges = ends.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    edges = edges.union(nodes.join(prints, "fp").where("node <> first").select("node", "first"))
    edges = edges.union(tied.where("doc_id <> node").join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    members = nodes.select(F.explode("bands").alias("key"), "node", "size")
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("pivot")).where("n > 1").drop("n")
    shared = written(grown(members).join(shared, "key"), "near-buckets")
    sizes = F.least("size", "other") >= least * F.greatest("size", "other")
    first = shared.withColumn("other", F.col("pivot.size")).where((F.col("node") != F.col("pivot.node")) & sizes)
    first = written(first.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    edges = written(edges.union(alike(known, first, width, least)), "near-edges")
    roots = components(edges)

    rooted = shared.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "near-rooted")
    parted = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    known_roots = written(rooted.join(parted, "key", "left_semi").groupBy("node").agg(F.any_value("root").alias("root")), "near-parted")
    sets = sets_of(known, known_roots.select(F.col("node").alias("doc_id")), width)
    rare = written(rarest(sets, least).withColumnRenamed("doc_id", "node").join(known_roots, "node"), "near-rarest")
    parts = rare.groupBy("s").agg(F.countDistinct("root").alias("parts"), F.max("short").alias("short"), F.count("*").cast("int").alias("m"))
    parts = written(parts.where("parts > 1 AND short").select(F.col("s").alias("region"), "m"), "near-meeting")
    boxes = rare.select(F.col("s").alias("region"), "node", F.col("size").cast("long").alias("n"), "root").join(parts.select("region"), "region", "left_semi")
    boxes = written(boxes.join(grown(count_vectors(sets).withColumnRenamed("row", "node")), "node"), "near-boxes")
    clusters = written(clustered(tiled(boxes, parts, 1024), int(least * 100 + 1e-9)), "near-clusters")
    rooted_sets = sets.withColumnRenamed("doc_id", "row").join(known_roots.toDF("row", "root"), "row")
    second = written(linked(rooted_sets, clusters, Fraction(least).limit_denominator(1_000_000), 1024), "near-rest")
    more = written(alike(known, second, width, least, sets), "near-more")
    if not more.isEmpty():
        roots = components(edges.union(more))
    named = tied.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("component_id"))
    return named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def first_of_groups(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` (all columns) that are the first of their ``near_groups`` group: the one with the smallest id.

    Of rows with one id, one stays. Rows without an id belong to no group and all stay.
    """
    first = written(near_groups(docs, width, least).where("doc_id = component_id").select("doc_id"), "near-first")
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))
