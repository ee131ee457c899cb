"""Ordered limits against plain Python on random inputs."""

import random

from docgauge import schemas as S
from docgauge.operators import answers as A
from docgauge.operators.common import first_n
from docgauge.operators.sampling import choose_link_targets, pick_evenly


def test_link_targets_match_the_greedy_loop(spark):
    rng = random.Random(7)
    sites, rows, expected = [], [], {}
    for s in range(40):
        key, root = f"s{s}", f"https://s{s}.test/docs"
        sites.append((key, root))
        seen, urls = set(), []
        for page in range(rng.randint(1, 6)):
            for ref in range(rng.randint(0, 25)):
                host = f"s{s}.test" if rng.random() < 0.5 else f"h{rng.randint(0, 11)}.test"
                url = f"https://{host}/{rng.randint(0, 40)}"
                rows.append((key, page, f"{root}/{page}", ref, url, None))
                if url not in seen:
                    seen.add(url)
                    urls.append(url)
        internal, external, per_host = [], [], {}
        for url in urls:
            host = url.split("/")[2]
            if host == f"s{s}.test":
                if len(internal) < 30:
                    internal.append(url)
            elif len(external) < 15 and per_host.get(host, 0) < 3 and (host in per_host or len(per_host) < 8):
                per_host[host] = per_host.get(host, 0) + 1
                external.append(url)
        expected[key] = set(internal + external)
    references = spark.createDataFrame(rows, "site_key string, page_ord int, from_url string, ref_ord int, url string, fragment string")
    chosen = choose_link_targets(references, spark.createDataFrame(sites, "site_key string, scope_root string")).collect()
    for key, urls in expected.items():
        assert {r.url for r in chosen if r.site_key == key} == urls


def test_pick_evenly_both_ways(spark):
    rng = random.Random(3)
    groups = {f"g{i}": sorted({f"https://x/{rng.randint(0, 9999)}" for _ in range(n)}) for i, n in enumerate((1, 9, 10, 11, 37, 500))}
    rows = [(g, u) for g, urls in groups.items() for u in urls] * 2
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "site_key string, loc string")
    expected = {
        (g, u) for g, urls in groups.items() for u in (urls if len(urls) <= 10 else [urls[int(i * (len(urls) / 10))] for i in range(10)])
    }
    for bounded in (True, False):
        got = pick_evenly(df, ["site_key"], "loc", 10, bounded=bounded).collect()
        assert {(r.site_key, r.loc) for r in got} == expected and len(got) == len(expected)


def test_large_limits_cut_salted_groups_first(spark):
    df = spark.range(5000).selectExpr("'hot' AS k", "pmod(id * 7919, 5000) AS v")
    got = sorted(r.v for r in first_n(df, ["k"], ["v"], 100).collect())
    assert got == list(range(100))


def greedy(candidates, pages):
    kept, seen, per_page = [], set(), {}
    for ordinal, question, url, facts, quote in candidates:
        key = question.strip().lower()
        if url not in pages or key in seen or not facts or quote not in pages[url] or per_page.get(url, 0) >= 2:
            continue
        seen.add(key)
        per_page[url] = per_page.get(url, 0) + 1
        kept.append(ordinal)
        if len(kept) == 8:
            break
    return kept


def test_question_choice_matches_the_greedy_loop(spark):
    rng = random.Random(11)
    questions, pages, expected = [], [], {}
    for s in range(60):
        site, texts = f"s{s}", {}
        for p in range(rng.randint(1, 12)):
            texts[f"https://d/{p}"] = f"alpha page {p} quote one two three"
        pages += [(site, url, "t", text, False) for url, text in texts.items()]
        rows = []
        for i in range(rng.choice([3, 12, 60, 200])):
            url = f"https://d/{rng.randint(0, 13)}"
            quote = "quote one two" if rng.random() < 0.9 else "missing words"
            rows.append((i, f" Q{rng.randint(0, rng.choice([3, 8, 40]))} ", url, ["f"] if rng.random() < 0.9 else [], quote))
        questions += [(site, i, q, u, f, e) for i, q, u, f, e in rows]
        expected[site] = greedy(rows, texts)
    got = A.select_questions(spark.createDataFrame(questions, S.QUESTIONS), spark.createDataFrame(pages, S.SOURCE_PAGES)).collect()
    for site, ordinals in expected.items():
        mine = sorted((r for r in got if r.site_key == site), key=lambda r: r.question_ord)
        assert [r.candidate_ord for r in mine] == ordinals


def test_a_question_dropped_by_the_page_limit_may_return_on_another_page(spark):
    text = "one two three"
    pages = spark.createDataFrame([("s", "P", "t", text, False), ("s", "Q", "t", text, False)], S.SOURCE_PAGES)
    rows = [("s", i, q, u, ["f"], "one two") for i, (q, u) in enumerate([("a", "P"), ("b", "P"), ("x", "P"), ("x", "Q")])]
    got = A.select_questions(spark.createDataFrame(rows, S.QUESTIONS), pages).orderBy("question_ord").collect()
    assert [(r.question, r.source_url) for r in got] == [("a", "P"), ("b", "P"), ("x", "Q")]
