"""Similarity join of shingle sets against all pairs."""

import random

import numpy as np
import pytest

from docgauge.llm import setjoin, similar
from tests.llm.helpers import clashing, documents, odd_rows, rows_of, words


def _set(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def _brute(rows, width=5, percent=80):
    sets = [_set(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)], key=repr)


def _edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def _corpus(rng):
    texts = [words(rng, rng.randrange(1, 80), 3000) for _ in range(60)]
    for base in texts[:12]:
        texts += [_edited(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 12))]
    passage = words(rng, 60, 10**6)
    texts += [f"{words(rng, 15, 10**6)} {passage} {words(rng, 15, 10**6)}" for _ in range(120)]  # alike by half, not linked
    crowd = words(rng, 200, 10**6)
    texts += [_edited(rng, crowd, rng.randrange(0, 7)) for _ in range(150)]  # some pairs link, some do not
    texts += [" ".join(crowd.split()[: rng.randrange(100, 200)]) for _ in range(60)]  # sizes matter
    texts += ["one two", "One  TWO", "one two three four five", "", "a b c d e f", "a b c d e g"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("tile", [1024, 20])
def test_components_match_all_pairs(spark, tile):
    rows = _corpus(random.Random(4))
    want = _brute(rows)
    got = rows_of(setjoin.similar_sets(documents(spark, rows).repartition(4), tile=tile), "doc_id", "n_shingles", "component_id")
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 100


def test_odd_rows(spark):
    rows = odd_rows(random.Random(3))
    got = rows_of(setjoin.similar_sets(clashing(documents(spark, rows))), "doc_id", "n_shingles", "component_id")
    assert got == _brute(rows)
    assert rows_of(setjoin.similar_sets(documents(spark, []))) == []


def test_tree_keeps_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 12, (8, setjoin.GROUPS))
    counts = (base[rng.integers(0, 8, 700)] + rng.integers(0, 2, (700, setjoin.GROUPS))).astype(np.int32)
    n, root = counts.sum(1).astype(np.int64), rng.integers(0, 300, 700)
    want = set()
    for x in range(700):
        minima = np.minimum(counts[x], counts).sum(1)
        fits = (180 * minima >= 80 * (n[x] + n)) & (root != root[x]) & (100 * np.minimum(n, n[x]) >= 80 * np.maximum(n, n[x]))
        want |= {(min(x, y), max(x, y)) for y in np.flatnonzero(fits).tolist()}
    x, y = setjoin.tree_pairs(counts, n, root, 80)
    assert {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())} == want and len(want) > 1000
    assert len(x) == len(want)


def test_prefixes_of_linked_sets_meet():
    """Of two sets of the wanted similarity one of the first groups is common, in any order of groups."""
    rng = random.Random(9)
    for _ in range(300):
        a = set(rng.sample(range(10**6), rng.randrange(5, 60)))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randrange(0, len(a) // 9 + 2)):
            b.discard(x)
            if rng.random() < 0.5:
                b.add(rng.randrange(10**6))
        if 100 * len(a & b) >= 80 * len(a | b):
            first = [set(sorted(s, key=hash)[: len(s) - -(-80 * len(s) // 100) + 1]) for s in (a, b)]
            assert first[0] & first[1]


def test_regions_in_one_batch_and_with_stars():
    key = np.array([1, 1, 1, 2, 2, 3])
    counts = np.tile(np.arange(setjoin.GROUPS, dtype=np.int32), (6, 1))
    n, node = counts.sum(1).astype(np.int64), np.array([10, 11, 12, 10, 13, 14])
    root = np.array([10, 10, 12, 10, 13, 14])
    for star, want in ((False, {(10, 12), (11, 12), (10, 13)}), (True, {(10, 12), (11, 12), (10, 13)})):
        x, y = setjoin.region_pairs(key, counts, n, root, node, star, 80)
        assert {(min(p), max(p)) for p in zip(node[x].tolist(), node[y].tolist())} == want


@pytest.mark.parametrize("operator", ["similar_sets", "near_groups"])
def test_no_table_holds_the_pairs_of_a_crowd(spark, monkeypatch, operator):
    """Copies of one text whose pairs lie just below the wanted similarity, a few of them linked."""
    rng = random.Random(12)
    crowd = words(rng, 200, 10**6)
    rows = [(i, _edited(rng, crowd, 4 + i % 3), None, None, None) for i in range(200)]
    rows += [(1000 + i, _edited(rng, rows[i][1], 1), None, None, None) for i in range(20)]
    module, plain, sizes = {"similar_sets": setjoin, "near_groups": similar}[operator], setjoin.written, []

    def written(df, name):
        out = plain(df, name)
        if out.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    for each in (setjoin, similar):
        monkeypatch.setattr(each, "written", written)
    got = {r.doc_id: r.component_id for r in getattr(module, operator)(documents(spark, rows)).collect()}
    if operator == "similar_sets":  # the other links by fingerprints too
        want = {i: c for i, _, c in _brute(rows)}
        assert got == want and len(set(want.values())) <= 200
    assert max(sizes) < 2 * len(rows)


def test_regions_of_two_unlike_points_are_left_out(spark):
    """Sizes too far apart, or the common group too far back; in crowds all stay."""
    rows = [(1, 100, 0, 7), (2, 79, 0, 7), (1, 100, 2, 8), (3, 90, 12, 8), (1, 100, 5, 9), (3, 90, 5, 9), (1, 100, 0, 10), (2, 10, 0, 10), (3, 90, 0, 10), (1, 100, 1, 11)]
    entered = spark.createDataFrame(rows, "node long, n long, place int, region long")
    assert set(rows_of(setjoin._crowding(entered, 80))) == {(9, 2), (10, 3)}


def test_copies_are_dropped_alike_by_shuffle(spark, monkeypatch):
    """Too many copies to send to all tasks: the same rows."""
    rng = random.Random(5)
    texts = [words(rng, 30, 10**6) for _ in range(10)]
    rows = [(i, texts[i % 10], None, None, None) for i in range(40)] + [(50, "", None, None, None), (51, None, None, None, None)]
    want = rows_of(setjoin.similar_sets(documents(spark, rows)))
    seen, plain = {}, setjoin.written

    def written(df, name):
        out = plain(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(setjoin, "written", written)
    monkeypatch.setattr(setjoin, "_FEW", 0)
    assert rows_of(setjoin.similar_sets(documents(spark, rows))) == want == sorted(_brute(rows), key=repr)
    assert seen["sets-copies"] == 30
