"""Quality, toxicity, language and backoff scores: held-out accuracy, brute force, and odd inputs."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docgauge.llm import language, lm, pu, quality, toxicity
from docgauge.llm.common import split_of
from tests.llm.helpers import clashing, documents, odd_rows, rows_of, words

LABELS = "doc_id long, quality int, toxic int"


def _labelled(rng: random.Random, n: int):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.25, rng.random() < 0.2
        text = words(rng, rng.randrange(30, 200), 3000)
        if bad:
            text = " ".join(w + rng.choice(["***", "###", "$$"]) for w in text.split())
        if toxic:
            text += " " + " ".join(rng.choice(["vile", "rotten", "nasty"]) for _ in range(4))
        rows.append((i, text, None, None, None))
        if rng.random() < 0.6:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_quality_and_toxicity_on_held_out_documents(spark):
    rng = random.Random(11)
    rows, labels = _labelled(rng, 900)
    df, marks = clashing(documents(spark, rows)), spark.createDataFrame(labels + labels[:5], LABELS)
    truth = {i: (q, t) for i, q, t in labels}
    for found, column in ((quality.quality_scores(df, marks), 0), (toxicity.toxicity_scores(df, marks), 1)):
        got = found.collect()
        assert sorted(r.doc_id for r in got) == list(range(900))
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id][column] for r in held]) > 0.93


def test_scores_of_odd_rows_and_without_labels(spark):
    rng = random.Random(12)
    rows = odd_rows(rng)
    df, none = clashing(documents(spark, rows)), spark.createDataFrame([], LABELS)
    for found in (quality.quality_scores(df, none), toxicity.toxicity_scores(df, none)):
        got = found.collect()
        assert len(got) == len(rows) and all(r.score == 0.5 for r in got)
    train, labels = _labelled(rng, 300)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABELS)
    both = documents(spark, rows + [(1000 + i, *rest) for i, *rest in train])
    marks = marks.withColumn("doc_id", F.col("doc_id") + 1000)
    got = quality.quality_scores(both, marks).collect()
    assert len(got) == len(both.collect()) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(both.limit(0), marks).count() == 0
    by_id = [r.score for r in got if r.doc_id == 2]
    assert len(by_id) == 2 and by_id[0] == by_id[1]


def test_style_does_not_depend_on_neighbours():
    texts = [b"One two two. THREE!!", b"", b"a", "ünï cödé | x".encode(), b"x " * 500]
    together = pu.style(*pu.laid(texts))
    apart = np.concatenate([pu.style(*pu.laid([t])) for t in texts])
    assert np.allclose(together, apart)
    wanted = np.zeros(1 << pu.SPACE_BITS, np.int16) - 1
    data, starts, _ = pu.laid(texts)
    hashes = [set(h.tolist()) for h in pu.grams(pu.laid([texts[0]])[0])]
    for column, h in enumerate(sorted(hashes[0] | hashes[1])):
        wanted[h] = column
    docs, cols = pu.gram_hits(data, starts, wanted)
    assert set(cols[docs == 0].tolist()) == set(range(len(hashes[0] | hashes[1])))


def test_risk_is_not_negative_learning():
    """With a prior far too large, the plain unbiased risk would be unbounded below; the corrected fit still tells the classes apart."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(2, 1, (300, 2)), rng.normal(2, 1, (200, 2)), rng.normal(-2, 1, (400, 2))))
    is_p = np.arange(900) < 300
    none = np.zeros(0, np.int64)
    order = rng.permutation(900)
    model = pu.fit_sample(x[order], none, none, none, is_p[order], None)
    assert 0.2 < model.prior < 0.5
    weights, _, bias = pu._descend(x, none, none, 0, is_p, 1 / 3)
    assert ((x @ weights + bias > 0) == (np.arange(900) < 500)).mean() > 0.97


def _bundle(text: str, dimension: int) -> np.ndarray:
    s = re.sub("\0+", "\0", "\0" + "".join(c if unicodedata.category(c)[0] == "L" else "\0" for c in (text or "").lower()) + "\0")
    out = np.zeros(dimension)
    for a, b, c in zip(s, s[1:], s[2:]):
        if b != "\0":
            v = [language.letter_vector(ord(x), dimension) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def test_languages_match_brute_force(spark):
    rng = random.Random(13)
    kinds = {"en": ["the", "and", "ing"], "de": ["sch", "ung", "ä"], "xx": ["qu", "zo"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(rng.randrange(1, 40))), k, None, None) for i in range(90) for k in [rng.choice(list(kinds))]]
    rows += odd_rows(rng)
    df = clashing(documents(spark, rows))
    learn = (split_of(F.col("doc_id"), 3) != 1) & F.col("doc_id").isNotNull()
    got = language.languages(df, learn, 256).collect()
    assert len(got) == len(rows)
    sums: dict = {}
    for i, t, k, *_ in rows:
        if i is not None and k and t and zlib.crc32(str(i).encode()) % 3 != 1:
            sums[k] = sums.get(k, 0) + _bundle(t, 256)
    sums = {k: v for k, v in sums.items() if v.any()}
    want = []
    for i, t, *_ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            want.append((i, "und", 0.0))
            continue
        v = _bundle(t, 256)
        cosines = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        want.append((i, best, round(max(0.0, cosines[best]), 6)))
    assert sorted([(r.doc_id, r.lang_pred, round(r.score, 6)) for r in got], key=repr) == sorted(want, key=repr)
    assert {(r.lang_pred, r.score) for r in language.languages(df, F.lit(False)).collect()} == {("und", 0.0)}
    assert language.languages(df.limit(0), learn).count() == 0


def test_backoff_scores_match_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, words(rng, rng.randrange(0, 60), 40), None, None, None) for i in range(80)] + odd_rows(rng)
    texts = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for _, t, *_ in rows]
    ones, twos = [Counter(w) for w in texts], [Counter(zip(w, w[1:])) for w in texts]
    all1, all2 = sum(ones, Counter()), sum(twos, Counter())
    n = sum(map(len, texts))
    want = []
    for (i, *_), w, one, two in zip(rows, texts, ones, twos):
        total = hits = unseen = 0
        for k, x in enumerate(w):
            c = all1[x] - one[x]
            rest = n - len(w)
            s = math.log(c / rest) if c else -math.log(rest + 1)
            unseen += not c
            if k:
                pair = all2[w[k - 1], x] - two[w[k - 1], x]
                s = math.log(pair / (all1[w[k - 1]] - one[w[k - 1]])) if pair else math.log(0.4) + s
                hits += pair > 0
            total += s
        want.append((i, round(total, 6), len(w), hits, unseen))
    df = clashing(documents(spark, rows)).repartition(3)
    for size in (500, 8_000_000):
        got = [(r.doc_id, round(r.log_score, 6) + 0.0, r.n_words, r.n_hits, r.n_unseen) for r in lm.backoff_scores(df, slice_bytes=size).collect()]
        assert sorted(got, key=repr) == sorted([(a, b + 0.0, *c) for a, b, *c in want], key=repr)
    assert lm.backoff_scores(df.limit(0)).count() == 0
    assert rows_of(lm.backoff_scores(documents(spark, [(1, "", None, None, None)]))) == [(1, 0.0, 0, 0, 0)]
