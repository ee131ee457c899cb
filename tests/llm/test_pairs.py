"""SimHash groups, forest search, repeated strings and decontamination against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docgauge.llm import ann, decontamination, similar, simhash, suffix
from docgauge.llm.graph import components
from docgauge.llm.wordhash import word_hashes
from tests.llm.helpers import clashing, documents, odd_rows, rows_of, words


def _print(text, width):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [w[i : i + width] for i in range(len(w) - width + 1)] or ([w] if w else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints: dict) -> dict:
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_golay_code_is_perfect_and_keys_meet():
    table, counts = simhash._cosets()
    assert counts.min() >= 1 and counts.max() == 6
    assert all(int(e).bit_count() <= 3 for e in table[:, 0])  # one error pattern of weight up to 3 for each syndrome
    rng = np.random.default_rng(0)
    p = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    q = p.copy()
    for i in range(len(p)):
        for b in rng.choice(64, 3, replace=False):
            q[i] ^= np.uint64(1) << np.uint64(int(b))
    near = set(zip(*(x.tolist() for x in simhash.segment_keys(q, True))))
    nearest = set(zip(*(x.tolist() for x in simhash.segment_keys(p, False))))
    assert {row for row, _ in near & nearest} == set(range(len(p)))


def test_simhash_groups_match_brute_force(spark):
    rng = random.Random(2)
    rows = [r for r in odd_rows(rng)]
    for i in range(100, 160):
        base = words(rng, 300).split()
        for k in range(3):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((i * 10 + k, " ".join(copy), None, None, None))
    prints = {}
    got = simhash.simhash_groups(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        if i is not None:
            prints[i] = _print(text, 3)
    want = _groups(prints)
    assert len(set(want.values())) < len(want) - 60
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.simhash_groups(documents(spark, [])).count() == 0


def test_crowds_link_without_all_pairs(spark):
    rng = random.Random(3)
    prints = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(150):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                x ^= 1 << b
            prints.add(x)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    want = _groups({signed[x]: x for x in prints})
    df = spark.createDataFrame([(x,) for x in want], "fp long")
    for crowd in (4, 10_000):
        edges = simhash.links(df, crowd)
        roots = {r.node: r.root for r in components(edges).collect()}
        assert {x: roots.get(x, x) for x in want} == want


def test_keys_of_fingerprints_are_not_sent_to_all_tasks(spark):
    """Spark sizes the keys by the fingerprints that they are made from, a few bytes each, and would broadcast them."""
    prints = spark.createDataFrame([((i * 0x9E3779B97F4A7C15 % (1 << 63)) ^ j,) for i in range(100) for j in range(3)], "fp long")
    for crowd in (64, 1):
        plan = simhash.links(prints, crowd)._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in "".join(line for line in plan.splitlines() if "Inner" in line)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1300)] + [(5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1, 201)} | {x: 1000 for x in range(1001, 1300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_first_of_groups_keeps_rows_without_id(spark):
    got = similar.first_of_groups(documents(spark, odd_rows(random.Random(1))))
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == [-9, 1, 3, 6, 7, 8]
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def _shingles(text):
    return set(simhash.shingle_hashes(text, 5))


def test_near_groups_match_all_pairs(spark):
    """Families whose members drift away from their first one, so that only chains connect them, and texts just below the threshold."""
    rng = random.Random(31)
    rows = [r for r in odd_rows(rng) if r[0] is not None]
    for family in range(12):
        text = words(rng, 150, 10**6).split()
        for k in range(12):
            rows.append((100 + family * 20 + rng.randrange(20) * 1000, " ".join(text), None, None, None))
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
    sets = [(i, _shingles(t), _print(t, 5)) for i, t, *_ in rows]
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    chained = 0
    for n, (a, x, p) in enumerate(sets):
        for b, y, q in sets[:n]:
            if (p ^ q).bit_count() <= 3 or x & y and len(x & y) >= 0.8 * len(x | y):
                chained += (p ^ q).bit_count() > 3
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    got = {r.doc_id: r.component_id for r in similar.near_groups(clashing(documents(spark, rows))).collect()}
    assert chained > 100 and got == {i: find(i) for i in root}
    left = similar.first_of_groups(documents(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i in root if find(i) == i)


def test_a_shared_passage_does_not_pair_unlike_texts(spark, monkeypatch):
    """Texts that meet in buckets by three fifths of their shingles, and pairs among them just above and below the threshold."""
    rng = random.Random(17)
    passage = words(rng, 90, 10**6)
    rows = [(i, f"{passage} {words(rng, 60, 10**6)}", None, None, None) for i in range(200)]
    for i in range(20):
        text = rows[i][1].split()
        for k in range(2 + i % 4):
            text[100 + 8 * k] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(text), None, None, None))
    sets = {i: _shingles(t) for i, t, *_ in rows}
    prints = {i: _print(t, 5) for i, t, *_ in rows}
    want = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                want[b] = min(want[b], want[a])
    plain, written_pairs = similar.alike, []

    def alike(docs, pairs, *others):
        written_pairs.append(pairs.count())
        return plain(docs, pairs, *others)

    monkeypatch.setattr(similar, "alike", alike)
    got = {r.doc_id: r.component_id for r in similar.near_groups(documents(spark, rows)).collect()}
    assert got == want and 5 < sum(i != r for i, r in want.items())
    assert written_pairs[1] < len(rows)


def test_bands_and_counts_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Spark sizes exploded bands and the count vectors of sets by few bytes of the files that they are made from."""
    plain, plans = similar.written, {}

    def written(df, name, *batch):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return plain(df, name, *batch)

    monkeypatch.setattr(similar, "written", written)
    similar.near_groups(documents(spark, odd_rows(random.Random(1)))).collect()
    for name in ("near-buckets", "near-boxes"):
        assert "BroadcastHashJoin" not in "".join(line for line in plans[name].splitlines() if "Inner" in line), name


def test_band_keys_depend_on_the_set_alone():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 50, dtype=np.uint64)
    both = np.concatenate((x, x[::-1], x[:5]))
    keys = similar.band_keys(np.concatenate((both, rng.integers(0, 2**63, 9, dtype=np.uint64))), np.array([50, 55, 9]))
    assert (keys[0] == keys[1]).all() and not (keys[0] == keys[2]).any() and len(set(keys.ravel().tolist())) == 2 * similar.BANDS


def _exact(vectors: dict, query: int, k: int) -> list:
    q = np.array(vectors[query], np.float32).astype(float)
    out = []
    for i, v in vectors.items():
        if i != query:
            x = np.array(v, np.float32).astype(float)
            out.append((-(x * q).sum() / (np.sqrt((x * x).sum()) * np.sqrt((q * q).sum())), i))
    return [i for _, i in sorted(out)[:k]]


VECTORS = "vec_id long, embedding array<float>, label int"


def test_forest_finds_the_nearest(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((6000, 24))
    base[1000:1400] = base[1000]  # copies
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, block=2500, least=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    vectors = {i: v for i, v, _ in rows}
    found = sum(len(set(_exact(vectors, q, 5)) & set(got[q])) for q in got)
    assert len(got) == 120 and found >= 0.9 * 5 * len(got)
    assert got[1000] == [1001, 1002, 1003, 1004, 1005] and got[1050] == [1000, 1001, 1002, 1003, 1004]


def test_forest_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (50, None, 0), (1, [0.0, 0.0], 0), (2, [nan, 1.0], 0), (3, [inf, 1.0], 0), (4, [None, 1.0], 0), (5, [], 0),
            (6, [2.0, 0.0], 0), (6, [2.0, 0.0], 0), (7, [0.0, 1.0], 0), (8, [1.0, 1.0, 1.0], 0), (None, [1.0, 0.0], 0), (100, [0.0, 3.0], 0), (100, [0.0, 3.0], 0)]
    df = clashing(spark.createDataFrame(rows, VECTORS))
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 0.0), (0, 3, 100, 0.0), (100, 1, 7, 1.0), (100, 2, 0, 0.0), (100, 3, 6, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def _plain(rows, length):
    count = {}
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in texts:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_match_brute_force(spark):
    rng = random.Random(8)
    shared = [words(rng, 12) for _ in range(4)]
    rows = odd_rows(rng)[:6] + odd_rows(rng)[7:]
    for i in range(200, 260):
        pieces = [words(rng, rng.randrange(1, 30)) for _ in range(3)] + rng.sample(shared, rng.randrange(0, 3))
        rng.shuffle(pieces)
        rows.append((i, "".join(pieces), None, None, None))
    rows += [(300, "ab" * 60, None, None, None), (301, "é" * 50, None, None, None), (302, "z" * 39, None, None, None), (303, "z" * 40, None, None, None)]
    df = clashing(documents(spark, rows))
    for length, gram, crowd in ((40, 16, 1000), (40, 16, 1), (200, 64, 1000)):
        assert rows_of(suffix.deduplicated(df, length, gram, crowd)) == _plain(rows, length)
    assert suffix.deduplicated(documents(spark, [])).count() == 0


def test_crowded_strings_are_counted_not_sorted(spark, monkeypatch):
    """A passage in all texts, cut off at many places, with different text around it."""
    rng = random.Random(12)
    passage = words(rng, 40)
    rows = []
    for i in range(150):
        a, b = sorted(rng.sample(range(len(passage)), 2)) if i % 3 == 0 else (0, len(passage))
        rows.append((i, words(rng, 6, 10**6) + passage[a:b] + words(rng, 6, 10**6), None, None, None))
    plain, most = suffix._sorted_groups, []

    def sorted_groups(given, length):
        most.append(given.groupBy("g", "ctx").count().agg(F.max("count")).first()[0] or 0)
        return plain(given, length)

    monkeypatch.setattr(suffix, "_sorted_groups", sorted_groups)
    want = _plain(rows, 40)
    for crowd in (3, 20, 60):
        assert rows_of(suffix.deduplicated(documents(spark, rows), 40, 16, crowd)) == want
    assert len(most) == 3 and max(most) <= 1


def test_texts_around_a_passage_are_not_cut_to_single_strings(spark, monkeypatch):
    """Pieces that share no core with another drop out, so finer cuts do not multiply rows (single strings would be over ten times the first cut)."""
    rng = random.Random(13)
    passage = words(rng, 60)
    rows = [(i, words(rng, 30, 10**6) + passage[i % 7 :] + words(rng, 30, 10**6), None, None, None) for i in range(150)]
    plain, made = suffix._pieces, []

    def pieces(given, length, step):
        found = plain(given, length, step)
        made.append((step, found.count()))
        return found

    monkeypatch.setattr(suffix, "_pieces", pieces)
    assert rows_of(suffix.deduplicated(documents(spark, rows), 200, 64, 4)) == _plain(rows, 200)
    assert [step for step, _ in made[:2]] == [16, 4]
    assert sum(n for _, n in made[1:]) < 2 * made[0][1]


def test_suffix_sort_orders_like_bytes():
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    starts = np.array(rng.sample(range(2900), 800))
    group = np.sort(np.array([rng.randrange(3) for _ in starts]))
    order = suffix.suffix_sort(suffix.Prefixes(data), starts, group, 60)
    key = [(g, data[s : s + 60].tobytes()) for g, s in zip(group[order], starts[order])]
    assert key == sorted(key) and sorted(order) == list(range(800))


def test_stage_keeps_rows_and_mends_characters(spark):
    tail = "ü" * 150
    rows = [(1, "a" + tail, None, None, 151), (2, "b" + tail, None, None, 151), (3, None, None, None, None), (4, "short", None, None, 5)]
    got = {r.doc_id: r for r in suffix.without_repeats(documents(spark, rows)).collect()}
    assert (got[1].text, got[1].n_chars, got[3].text, got[4].text, got[4].n_chars) == ("a", 1, None, "short", 5)


def _tiles(doc, item, least):
    """Greedy tiling by trying all places."""
    fd, fi, out = [True] * len(doc), [True] * len(item), 0
    while True:
        best, found = 0, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and fd[d + n] and fi[i + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, d)]
                elif n == best:
                    found.append((i, d))
        if best < least:
            return out
        for i, d in found:
            if all(fi[i : i + best]) and all(fd[d : d + best]):
                fi[i : i + best] = fd[d : d + best] = [False] * best
                out += best


def test_tiling_matches_trying_all_places():
    rng = np.random.default_rng(0)
    for _ in range(150):
        doc, item = (rng.integers(0, 3, n).astype(np.uint64) for n in (30, 20))
        tiles = decontamination.greedy_tiles(doc, item, 3)
        assert sum(n for _, _, n in tiles) == _tiles(doc.tolist(), item.tolist(), 3)
        assert all((item[i : i + n] == doc[d : d + n]).all() for i, d, n in tiles)


def test_decontamination(spark):
    rng = random.Random(4)
    item = words(rng, 40).split()
    other = words(rng, 30)
    around = lambda: words(rng, 50, 100_000)
    rows = odd_rows(rng) + [
        (50, f"{around()} {' '.join(item)} {around()}", None, None, None),
        (51, f"{around()} {' '.join(item[25:])}. {around()}, {' '.join(item[:25]).upper()} {around()}", None, None, None),
        (52, f"{around()} {' '.join(item[:12])} {around()}", None, None, None),
        (53, " ".join(x for k in range(0, 40, 4) for x in (*item[k : k + 4], "zzz")), None, None, None),
        (None, " ".join(item), None, None, None),
        (54, other, None, None, None), (54, other, None, None, None),
    ]
    items = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, other), (3, "too short"), (4, None), (None, " ".join(item)), (5, "")], "item_id long, text string")
    df = documents(spark, rows)
    found = decontamination.contaminated(clashing(df).drop("key"), items)
    assert rows_of(found, "doc_id", "item_id", "reordered") == sorted([(50, 1, False), (51, 1, True), (None, 1, False), (54, 2, False), (54, 2, False)], key=repr)
    assert all(r.coverage == 1.0 for r in found.collect())
    kept = decontamination.clean(df, items)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows[:13] + rows[15:17])
    assert decontamination.contaminated(df, items.limit(0)).count() == 0 and decontamination.contaminated(df.limit(0), items).count() == 0


def test_word_hashes_part_texts_alike():
    texts = ["One, two!", None, "", "zwei-drei ÉTÉ 漢字\nx", "one two"]
    hashes, of = word_hashes(texts)
    assert np.bincount(of, minlength=5).tolist() == [2, 0, 0, 5, 2]
    assert (hashes[:2] == hashes[-2:]).all() and len(set(hashes.tolist())) == 7
