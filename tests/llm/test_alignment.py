"""Alignment of two tokenizers against a plain loop over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from docgauge.llm import alignment
from tests.llm.helpers import clashing, documents, odd_rows, rows_of, words

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return alignment.pair_of(*(open(f"{alignment.FOLDER}/{name}", "rb").read() for name in FILES))


def _brute(pair, texts):
    """doc number -> the columns of the contract, by comparing all byte ranges of neighbouring tokens."""
    slow = Tokenizer.from_file(f"{alignment.FOLDER}/{FILES[0]}")
    slow.encode_special_tokens = True
    links, numbers = {}, {}
    for i, text in enumerate(texts):
        links[i], numbers[i] = [], (0, 0, 0, "")
        if not text:
            continue
        a, b = slow.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        spelled = b" " + text.encode()
        if b"".join(pair.a_bytes[x] for x in a) != spelled or b"".join(pair.b_bytes[x] for x in b) != spelled:
            continue
        spans = []
        for ids, known in ((a, pair.a_bytes), (b, pair.b_bytes)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(known[x]), x))
                at += len(known[x])
            spans.append(out)
        first = 0
        for s, e, x in spans[0]:
            while first < len(spans[1]) and spans[1][first][1] <= s:
                first += 1
            for s2, e2, y in spans[1][first:]:
                if s2 >= e:
                    break
                links[i].append((x, y))
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        told, at = [], [0, 0]
        for high in common:
            sides = []
            for k, side in enumerate(spans):
                first = at[k]
                while at[k] < len(side) and side[at[k]][1] <= high:
                    at[k] += 1
                sides.append(",".join(str(x) for _, _, x in side[first : at[k]]))
            told.append("|".join(sides))
        numbers[i] = (len(a), len(b), len(common), hashlib.sha256(";".join(told).encode()).hexdigest())
    held = Counter(p for found in links.values() for p in set(found))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return {
        i: (*numbers[i][:3], len(found), sum(held[p] == best[p[0]] for p in found), sum(held[p] for p in found), numbers[i][3])
        for i, found in links.items()
    }


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_matches_brute_force(spark, pair):
    rng = random.Random(5)
    letters = "aaaaeeiou nrst\n\t.,;'é漢🙂▁  \x00\x7f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(60)]
    texts += [" ".join(rng.choice(["the", "The", "quasiparticle", "tokens", "12,345", "<|endoftext|>", "<s>", "  ", "xqzzv", "aaaaaaa", "don't"]) for _ in range(80)) for _ in range(60)]
    texts += ["", "aaaa" * 50, " lead", "trail ", "x", "ﬁ é", "é", "a▁b"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want = _brute(pair, texts)
    for slice_bytes in (8_000_000, 2_000):
        got = alignment.align(documents(spark, rows).repartition(3), slice_bytes=slice_bytes)
        assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) > 60 and want[len(texts) - 1] == (0, 0, 0, 0, 0, 0, "")


def test_pairs_of_the_identity_never_become_rows(spark, pair):
    rows = [(i, "the cat sat on the mat and the dog was there", "en", "s", 1) for i in range(20)]
    files = tuple(open(f"{alignment.FOLDER}/{name}", "rb").read() for name in FILES)
    slices = alignment._slices(documents(spark, rows), files, 8_000_000)
    vector, odd, totals = alignment.pair_counts(slices, pair.identity)
    the = pair.slow.token_to_id("Ġthe")
    assert vector[the] == 20 and pair.b_bytes[pair.identity[the]] == b" the"
    named = {a << alignment._B_BITS | int(pair.identity[a]) for a in range(len(pair.identity))}
    assert not named & {r["pair"] for r in odd.collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_both_encoders_of_a_agree(pair, text):
    assert pair.fast is not None
    assert pair.encode_a(text) == pair.slow.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, pair):
    rows = odd_rows(random.Random(3))
    want = _brute(pair, [r[1] for r in rows])
    got = rows_of(alignment.align(clashing(documents(spark, rows))), "doc_id", *COLUMNS)
    assert got == sorted(((r[0], *want[i]) for i, r in enumerate(rows)), key=repr)
    assert rows_of(alignment.align(documents(spark, []))) == []


def test_one_text_in_most_rows(spark, pair):
    rng = random.Random(8)
    text = words(rng, 50)
    rows = [(i, text if i % 3 else words(rng, 40), "en", "s", 1) for i in range(300)]
    want = _brute(pair, [r[1] for r in rows])
    got = alignment.align(documents(spark, rows).repartition(5), slice_bytes=3_000)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want
