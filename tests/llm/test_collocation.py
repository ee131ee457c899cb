"""Phrase mining against a plain count of all phrases."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docgauge.llm import collocation
from tests.llm.helpers import clashing, documents, odd_rows, rows_of

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _brute(rows, longest=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found, out = {}, []
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], score)
    dropped = set()
    for (lang, p), (longer, *_) in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                part = (lang, p[i : i + k])
                if 100 * longer >= cover * found[part][0]:
                    dropped.add(part)
    for lang in {x for x, _ in found}:
        mine = sorted((-v[3], -v[0], " ".join(p).encode(), v) for (x, p), v in found.items() if x == lang and (x, p) not in dropped)
        out += [(lang, i + 1, p.decode(), *v[:3], n[lang], v[3]) for i, (_, _, p, v) in enumerate(mine[:top])]
    return sorted(out, key=repr)


def _texts(rng, count):
    """Texts of few words, so that many phrases are frequent, with fixed expressions and breaks."""
    fixed = ["new york city", "of the", "à la carte", "A b C", "zz zz zz zz"]
    rows = []
    for i in range(count):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice("abcd") + rng.choice(["", "É", "漢"]) for _ in range(rng.randrange(1, 160))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "?", "-"]) for p in parts), rng.choice(["en", "en", "de", None, "und"]), "s", 1))
    return rows


def test_phrases_match_brute_force(spark):
    rows = _texts(random.Random(1), 300)
    want = _brute(rows)
    assert len(want) > 100
    for shards, slots in ((2, 1 << 23), (4, 1 << 16), (1, 1 << 23)):
        assert rows_of(collocation.collocations(documents(spark, rows).repartition(3), shards=shards, most_slots=slots), *COLUMNS) == want


def test_crowded_slots_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocation, "_sized", lambda n, most: 64)
    monkeypatch.setattr(collocation, "_BLOCK", 64)
    rows = _texts(random.Random(2), 120)
    assert rows_of(collocation.collocations(documents(spark, rows), shards=3), *COLUMNS) == _brute(rows)


def test_longer_phrases_and_first_rows(spark):
    rows = _texts(random.Random(3), 150)
    got = rows_of(collocation.collocations(documents(spark, rows), longest=5, least=8, top=7), *COLUMNS)
    assert got == _brute(rows, longest=5, least=8, top=7)


def test_a_phrase_that_becomes_frequent_late_is_counted_over_a_whole_cycle(spark):
    rows = [(i, "early words here", "en", "s", 1) for i in range(9)] + [(100 + i, "early words", "en", "s", 1) for i in range(3)]
    docs = spark.createDataFrame([(*r[:3], s) for r, s in zip(rows, [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2, 0])], "doc_id long, text string, lang string, shard int")
    keys = {r["key"] for r in collocation.frequent(docs, 3, 10, 3, 1 << 16).collect()}
    words = collocation.words_of(["early words"])
    import numpy as np

    h = words.hashes(np.array([collocation._seed("en")], np.uint64), collocation._BASES[0])
    want = {int(k) for _, all_keys, whole in words.phrases(h, 2) for k in all_keys[whole].view(np.int64)}
    assert keys == want


def test_odd_rows(spark):
    rows = odd_rows(random.Random(3)) * 6
    got = rows_of(collocation.collocations(clashing(documents(spark, rows))), *COLUMNS)
    assert got == _brute(rows) and got
    assert rows_of(collocation.collocations(documents(spark, []))) == []


def test_products_beyond_64_bits(spark):
    big = 5 * 10**9
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 0, "", 2 * big)], "lang string, size int, phrase string, n long")
    assert rows_of(collocation.scored(counts, 10), "a", "l", "r", "score") == [(big - 1, big, big, 10**6 * (big - 1) ** 2 // big**2)]


def test_tables_of_slots_are_gathered_by_few_jobs(spark):
    docs = documents(spark, _texts(random.Random(4), 60))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    group = "gathered-by-few-jobs"
    try:
        for c, v in zip(kept, ("40", "false")):
            spark.conf.set(c, v)
        keys = docs.select(F.xxhash64("text").alias("key"), F.lit(1).alias("value"))
        spark.sparkContext.setJobGroup(group, "")
        low, high = collocation._blocks(keys, 1 << 20)
        bits = collocation._bitmap(keys, 1 << 20)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for c, v in kept.items():
            spark.conf.set(c, v)
    slots = {((r["key"] >> 4) & ((1 << 20) - 1)) for r in keys.collect()}
    assert set(np.flatnonzero(high == 1).tolist()) == set(np.flatnonzero(low == 1).tolist()) == set(np.flatnonzero(np.unpackbits(bits)).tolist()) == slots
    assert jobs <= 2 * (collocation._JOBS + 4)


def test_a_task_takes_few_characters_apart_at_a_time():
    texts = [f"w{i % 97} x{i % 89} " * 500 for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    tracemalloc.start()
    try:
        found = sum(len(words.begin) for _, words in collocation._chunks(iter([batch])) if len(words.hashes(np.zeros(len(texts), np.uint64), collocation._BASES[0])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 1_000_000
    assert peak < 60_000_000, peak
