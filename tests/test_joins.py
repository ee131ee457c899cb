"""Joins that replaced nested tests, against plain loops over every pair."""

import random
import re
import time

from docgauge.operators import agentdocs as G, answers as A, scoring
from docgauge.sources import robots as R
from workload import captures as C


def matches(pattern, path):
    closed = pattern.endswith("$")
    body = re.escape(pattern[:-1] if closed else pattern).replace(r"\*", ".*")
    return re.match(body + ("$" if closed else ""), path) is not None


def decided(rules, token, path):
    """Longest matching rule of the agent's own group, allow on a tie."""
    mine = [r for r in rules if r[0] == token] or [r for r in rules if r[0] == "*"]
    hits = [(len(p), allow) for _, allow, p in mine if p and matches(p, path)]
    return path == "/robots.txt" or not hits or max(hits)[1]


def test_robots_access_equals_every_rule_on_every_path(spark):
    rng = random.Random(5)
    piece = lambda: rng.choice(["a", "b", "ab", "/", ".", "+", "(x)", "é"])
    rules = [(rng.choice(["*", "ourbot"]), rng.random() < 0.5, "/" + "".join(rng.choice([piece(), piece(), "*", "$"]) for _ in range(rng.randint(0, 5)))) for _ in range(150)]
    rules += [("*", False, ""), ("*", True, "*"), ("*", False, "*.b$"), ("ourbot", False, "/a"), ("ourbot", True, "/a"), ("ourbot", False, "$")]
    paths = sorted({"/" + "".join(piece() for _ in range(rng.randint(0, 6))) for _ in range(120)} | {"/robots.txt", "/", ""})
    files = spark.createDataFrame([("o", "ok"), ("down", "unreachable")], "origin string, state string")
    table = spark.createDataFrame([("o", agent, allow, p) for agent, allow, p in rules], "origin string, agent string, allow boolean, pattern string")
    rows = [("o", p) for p in paths] + [("o", None), ("down", "/a"), ("none", "/a"), (None, "/a")]
    targets = spark.createDataFrame(rows + rows[:3], "origin string, path string")
    got = {(r.origin, r.path, r.agent): r.allowed for r in R.robots_access(targets, files, table, ["OurBot/2", "Other"]).collect()}
    assert len(got) == 2 * len(rows)
    for path in paths:
        assert got["o", path, "OurBot/2"] == decided(rules, "ourbot", path), path
        assert got["o", path, "Other"] == decided(rules, "other", path), path
    assert got["down", "/a", "Other"] is None and got["none", "/a", "Other"] and got[None, "/a", "Other"] and got["o", None, "Other"]


def test_robots_access_of_one_large_origin(spark):
    n = 10_000
    files = spark.createDataFrame([("o", "ok")], "origin string, state string")
    number = spark.range(n)
    rules = number.selectExpr("'o' AS origin", "'*' AS agent", "id % 3 = 0 AS allow", "concat('/d', id, CASE WHEN id % 5 = 0 THEN '/*/x' ELSE '/' END) AS pattern")
    targets = number.selectExpr("'o' AS origin", "concat('/d', id, '/p/x') AS path")
    began = time.time()
    got = {r.path: r.allowed for r in R.robots_access(targets, files, rules, ["*"]).collect()}
    assert time.time() - began < 20  # a hundred million pattern tests take minutes
    assert got == {f"/d{i}/p/x": i % 3 == 0 for i in range(n)}


def holds(text, quote):
    clean = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    needle, hay = clean(quote), clean(text)
    words, known = needle.split(" "), set(hay.split(" "))
    return needle != "" and (needle in hay or (len(words) >= 5 and sum(w in known for w in words) / len(words) >= 0.85))


def test_quote_pages_equal_every_quote_on_every_page(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("a b an the then cat concat tenate concatenate zebra x9 rare quick".split())
    pages = [(s, f"u{i}", " ".join(word() for _ in range(rng.randint(0, 14)))) for s in ("s", "t") for i in range(40)]
    pages += [("s", "none", None), ("s", "u0", "a second text of one page: the zebra then"), ("v", "u", "")]
    quotes = [(s, i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 20, 21])))) for s in ("s", "t", "w") for i in range(60)]
    quotes += [("s", 100 + i, q) for i, (_, _, t) in enumerate(pages) if t for q in (t, t[2:-2])]
    quotes += [("s", 900, None), ("s", 901, " .!"), ("s", 902, "at"), ("s", 903, "e z"), ("s", 904, "The, ZEBRA!"), ("s", 0, "zebra")]
    questions = spark.createDataFrame(quotes, "site_key string, question_ord int, evidence_quote string")
    got = {tuple(r) for r in A.quote_pages(questions, spark.createDataFrame(pages, "site_key string, url string, text string")).collect()}
    want = {(s, i, u) for s, i, q in quotes for p, u, t in pages if s == p and q is not None and t is not None and holds(t, q)}
    assert got == want and len(want) > 500


def test_quote_pages_of_few_quotes_equal_those_of_many(spark, monkeypatch):
    rng = random.Random(10)
    word = lambda: rng.choice("a b an the then cat concat tenate concatenate zebra x9 rare quick".split())
    pages = [(s, f"u{i}", " ".join(word() for _ in range(rng.randint(0, 14)))) for s in ("s", "t") for i in range(20)]
    pages += [("s", "none", None), ("s", "u0", "a second text of one page: the zebra then"), ("s", None, "a cat then the rare zebra x9 quick"), ("v", "u", "")]
    quotes = [(s, i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 13])))) for s in ("s", "t", "w") for i in range(20)]
    quotes += [("s", 90, None), ("s", 91, " .!"), ("s", 92, "at"), ("s", 0, "zebra"), (None, 1, "zebra")]
    questions = spark.createDataFrame(quotes, "site_key string, question_ord int, evidence_quote string")
    want = {(s, i, u) for s, i, q in quotes for p, u, t in pages if s == p and q is not None and t is not None and holds(t, q)}
    for few in (0, 20, 64):
        monkeypatch.setattr(A, "_FEW_QUOTES", few)
        got = [tuple(r) for r in A.quote_pages(questions, spark.createDataFrame(pages, "site_key string, url string, text string")).collect()]
        assert len(got) == len(want) and set(got) == want, few


def in_turn(rows, rules, ordered):
    """Rules one by one over a site's rows ``(ord, id, status)``."""
    rows = sorted(rows)
    good = lambda r: r in ("pass", "warn")
    ran = {i for _, i, _ in rows}
    if ordered:
        ok = {i for i in ran if good([s for _, j, s in rows if j == i][-1])}
    else:
        ok = {i for _, i, s in rows if good(s)}
    cut = set()
    for check, groups in rules:
        if any(d in ran for g in groups for d in g) and not all(any(d in ok for d in g) for g in groups):
            cut.add(check)
            ok.discard(check)
    return sorted((o, i, "skip" if i in cut else s) for o, i, s in rows)


def test_check_dependencies_equal_rules_taken_in_turn(spark):
    rng = random.Random(3)
    ids = [f"c{i}" for i in range(140)]  # more than two words of bits
    rows = [(f"s{k}", o, rng.choice(ids[:12] if k % 2 else ids), rng.choice(["pass", "warn", "fail", "skip", "error", None]), "m", 1.0) for k in range(40) for o in range(rng.randint(1, 30))]
    known = [(s, o, i, st or "", "m", 1.0) for s, o, i, st, _, _ in rows]
    schema = "site_key string, ord int, id string, status string, message string, earned double"
    df = spark.createDataFrame(known, schema)
    pick = lambda: rng.choice(ids[:12])
    for trial in range(3):
        rules = [(pick(), [[pick() for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 2))]) for _ in range(8)] + [(ids[130], [[ids[70]], [ids[1], ids[139]]])]
        for order in (None, ["ord"]):
            got = {}
            for r in G.check_dependencies(df, rules, order).collect():
                got.setdefault(r.site_key, []).append((r.ord, r.id, r.status))
                assert (r.earned is None) == (r.message != "m")
            for site in {r[0] for r in known}:
                mine = [(o, i, st) for s, o, i, st, _, _ in known if s == site]
                assert sorted(got[site]) == in_turn(mine, rules, order), (trial, site, rules)
    odd = spark.createDataFrame([(None, 0, "c1", "fail", "m", 1.0), ("s", 0, None, "fail", "m", 1.0), ("s", 1, "c2", None, "m", 1.0), ("s", 2, "c1", "fail", "m", 1.0)], schema)
    left = {(r.site_key, r.id): r.status for r in G.check_dependencies(odd, [("c2", [["c1"]])]).collect()}
    assert left == {(None, "c1"): "fail", ("s", None): "fail", ("s", "c2"): "skip", ("s", "c1"): "fail"}
    assert G.check_dependencies(odd.limit(0), [("c2", [["c1"]])]).count() == 0


def test_score_rollup(spark):
    rows = [("a", "access", "x", "pass", 0.1, 0.3), ("a", "access", "x", "fail", 0.2, 0.3), ("a", "access", "y", "skip", None, 4.0), ("a", "freshness", "y", "unverified", None, 2.0), ("b", None, "x", "warn", 1.0, 8.0)]
    df = spark.createDataFrame(rows, "site_key string, group string, category string, status string, earned double, max double")
    got = {(r.level, r.site_key, r.group, r.category): (r.checks, r.counted, r.unverified, r.earned, r.possible, r.score) for r in scoring.score_rollup(df).collect()}
    assert got == {
        (0, None, None, None): (5, 3, 1, 1.3, 8.6, 15), (1, "a", None, None): (4, 2, 1, 0.3, 0.6, 50), (1, "b", None, None): (1, 1, 0, 1.0, 8.0, 13),
        (2, "a", "access", None): (3, 2, 0, 0.3, 0.6, 50), (2, "a", "freshness", None): (1, 0, 1, 0.0, 0.0, None), (2, "b", None, None): (1, 1, 0, 1.0, 8.0, 13),
        (3, "a", "access", "x"): (2, 2, 0, 0.3, 0.6, 50), (3, "a", "access", "y"): (1, 0, 0, 0.0, 0.0, None), (3, "a", "freshness", "y"): (1, 0, 1, 0.0, 0.0, None),
        (3, "b", None, "x"): (1, 1, 0, 1.0, 8.0, 13),
    }


def test_first_words_read_no_more_than_these_words(spark):
    texts = ["", " ", None, "one", "  a\tb \n c d", "a\x0bb c", "\u00a0x y z", "w" * 20_000 + " b c d", " ".join(map(str, range(50))) + " "]
    words = C.first_words("text", 3)
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(words.alias("w")).collect()
    assert [r.w for r in got] == [t if t is None else re.sub("[\t\n\f\r ]+", " ", t).strip(" ").split(" ")[:3] for t in texts]
    assert "regexp_replace(text," not in str(words)
