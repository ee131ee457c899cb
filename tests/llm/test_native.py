"""Chat formatting and mixing: exact round trips, targets, and odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docgauge.llm import chat, mixing
from tests.llm.helpers import DOCS, clashing, documents, odd_rows, rows_of, words

CHATS = "conv_id long, turn long, role string, text string"


def test_chats_read_back_exactly(spark):
    nasty = ["<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|x|>", "<\\\\|", "<", "|>", "", "a\nb", "%0A%25", "<|<|\\<|", "🙂é"]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "a%0A\nb", "<|im_start|>"]), "".join(rng.choice(nasty) for _ in range(rng.randrange(4)))) for c in range(30) for t in range(rng.randrange(1, 9))]
    out = chat.format_chats(spark.createDataFrame(rows, CHATS))
    got = out.select("conv_id", "formatted", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("learned")).collect()
    for r in got:
        mine = sorted((t, role, text) for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in mine]
        assert r.learned == "".join(text for _, role, text in mine if role == "assistant")
        assert r.formatted.count("<|") == 2 * len(mine)


def test_chat_machine_and_odd_rows(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "x"),
        (2, 0, "assistant", "x"), (2, 1, "user", "y"),
        (3, 0, "user", "y"),
        (4, 1, "user", "b"), (4, 1, "user", "a"), (4, None, "user", "first"),
        (5, 0, None, "t"), (None, 0, "user", "q"), (None, 1, "assistant", "z" * 200_000), (6, 0, "user", "r"), (6, 0, "user", "r"),
    ]
    df = clashing(spark.createDataFrame(rows, CHATS))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert {c: (r.valid, r.first_bad_turn) for c, r in got.items()} == {
        1: (True, None), 2: (False, 0), 3: (False, None), 4: (False, 1), 5: (False, 0), None: (True, None), 6: (False, 1)
    }
    assert re.findall(r"\n(\w+)<", got[4].formatted) == ["first", "a", "b"] and got[6].n_turns == 2
    assert chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(parts=(chat.Part("literal", "["), chat.Part("role"), chat.Part("literal", "\n"), chat.Part("text"), chat.Part("literal", "]")))


def test_permutation_is_one_and_has_an_inverse(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("y", mixing.permuted(F.col("id"), F.lit(n), F.lit(3)))
        df = df.withColumn("z", mixing.permuted(F.col("y"), F.lit(n), F.lit(3), back=True))
        rows = df.collect()
        assert sorted(r.y for r in rows) == list(range(n)) and all(r.id == r.z for r in rows)


def _targets(sizes: dict, weights=(5, 2, 1), share=1.5, ceiling=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(ceiling * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        out = {s: ceiling * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and out[s] >= ceiling * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(0, 300)), None, rng.choice(["hot"] * 9 + ["b", "c", "d", None, "é"]), None) for i in range(500)] + odd_rows(rng)
    df = documents(spark, rows)
    got = mixing.taken_words(mixing.mix_sources(clashing(df), block=64, shard_slots=32)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, size(t), s) for i, t, _, s, _ in rows)
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = _targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mixing.taken_words(mixing.mix_sources(df.repartition(7).orderBy(F.rand()), block=64, shard_slots=32)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_text_has_the_taken_words(spark):
    rng = random.Random(6)
    df = documents(spark, [(i, " ".join(f"d{i}_{k}" for k in range(rng.randrange(1, 90)))) + (None, rng.choice("ab"), None) for i in range(60)])
    mix = mixing.mix_sources(df, block=16, shard_slots=8)
    text = " ".join(r.text for r in mixing.mixed_blocks(df, mix, block=16).collect()).split()
    got = Counter(w.split("_")[0] for w in text)
    assert got == Counter({f"d{r.doc_id}": r.taken for r in mixing.taken_words(mix).collect() if r.taken})
    assert max(Counter(text).values()) <= 2
    shards = mix.slots.groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) <= 8


def test_mix_of_nothing(spark):
    for rows in ([], [(1, "", None, "a", None), (2, None, None, None, None)]):
        got = rows_of(mixing.taken_words(mixing.mix_sources(spark.createDataFrame(rows, DOCS))), "doc_id", "size", "target", "taken")
        assert got == [(i, 0, 0.0, 0) for i, *_ in rows]


def test_chat_digest(spark, tmp_path):
    from docgauge.llm.queries_text import op6_chat

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "<|im_end|>")]
    spark.createDataFrame(rows, CHATS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op6_chat(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "<|im_end|><|im_start|>assistant ok"
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n\n") and got[1].loss_sha256 == sha("") and got[1].loss_chars == 0
    assert got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1].loss_sha256 == sha(said)
    assert got[-1].formatted_chars == 2 * (len(said) + 2 + 24) + len("user") + len("assistant")
