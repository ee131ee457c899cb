"""Registered queries against their SQL on documents that the given tables hardly have."""

import re
import shutil

import pyarrow as pa
import pyarrow.parquet as pq

from workload import load
from workload.check import compare, connect

SMALL = "/root/testdata/sf0.001"


def documents(folder, texts, langs=("en", "de", "fr", "es")):
    """A copy of the smallest tables whose documents are ``texts``."""
    shutil.copytree(SMALL, folder, ignore=shutil.ignore_patterns("documents.parquet"))
    ids = pa.array(range(len(texts)), pa.int64())
    lang = [langs[i // 20 % len(langs)] for i in range(len(texts))]
    rows = {"doc_id": ids, "text": texts, "lang": lang, "source": ["s"] * len(texts), "n_chars": [len(t) for t in texts]}
    pq.write_table(pa.table(rows), f"{folder}/documents.parquet")
    return str(folder)


def agrees(spark, folder, *names):
    queries, oracles = load()
    con = connect(folder)
    for name in names:
        problem = compare(spark, con, queries[name], oracles[name], folder)
        assert problem is None, f"{name}: {problem}"


def test_words_that_the_entry_page_holds_are_no_evidence(spark, tmp_path):
    words = ["El.", "Come", "me", "A.", "one two three\vfour five", "No. El."]
    agrees(spark, documents(tmp_path / "sf", [words[i * 7 // 3 % len(words)] for i in range(240)]), "evidence_reached", "grounded_quotes")


def test_kept_tables_hold_no_page_text(spark):
    queries, _ = load()
    for name in ("choose_link_targets", "anchor_verdicts", "sitemap_live", "spec_match"):
        result = queries[name](spark, SMALL)
        plan = result._jdf.queryExecution().withCachedData().toString()
        held = [line for line in plan.splitlines() if "InMemoryRelation [" in line]
        assert not [line for line in held if " text#" in line or "[text#" in line], name


def test_blanks_collapse_as_by_one_pattern(spark):
    from pyspark.sql import functions as F

    from docgauge.functions.text import WHITESPACE, collapse

    texts = ["a b", " a  b ", "a\n b", "a \n b", " a", "a  ", "\ta　 b  c", " ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(collapse(F.col("t")), F.trim(F.regexp_replace("t", WHITESPACE, " "))).collect()
    assert all(a == b for a, b in got)


def test_source_pages_move_prompts_not_texts(spark):
    queries, _ = load()
    execution = queries["source_page_filter"](spark, SMALL)._jdf.queryExecution()
    told = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")
    moved = [block for block in told.split("\n\n") if ") Exchange\n" in block]
    assert moved and not [block for block in moved if "text#" in block.replace("prompt_text#", "") or " rendered#" in block]


def test_quote_pages_move_pages_once(spark):
    """Every step that reads page texts reads the same columns, so that Spark shuffles them once."""
    queries, _ = load()
    plan = queries["quote_pages"](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    made = [re.sub(r"#\d+L?|^[ :+-]*", "", line) for line in plan.splitlines() if " AS hay" in line]
    assert len(made) > 3 and len(set(made)) == 1
