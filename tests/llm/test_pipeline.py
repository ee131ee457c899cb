"""The pipeline keeps clean documents, and each stage's decision takes effect on the next."""

import random

import pyarrow as pa

from docgauge.llm.common import table, written
from tests.llm.helpers import documents, words


def _corpus(spark, folder):
    rng = random.Random(21)
    items = [words(rng, 40, 10**6) for _ in range(4)]
    passage = words(rng, 60, 10**6)
    rows, labels, kind = [], [], {}

    def add(text, what, quality=None):
        i = len(rows)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        kind[i] = what
        if quality is not None:
            labels.append((i, quality, 0))

    for _ in range(1500):
        add(words(rng, rng.randrange(40, 90), 10**6), "clean", 1)
    for _ in range(400):
        add(" ".join(w + "***###" for w in words(rng, 60, 10**6).split()), "junk", 0)
    for i in range(0, 20, 2):
        add(rows[i][1], "copy")
    for _ in range(4):
        add(f"{words(rng, 50, 10**6)} {passage} {words(rng, 50, 10**6)}", "passage")
    for item in items:
        add(f"{words(rng, 50, 10**6)} {item[:120]} {words(rng, 3, 10**6)} {item[120:]} {words(rng, 50, 10**6)}", "leak")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return kind, passage


def test_every_stage_takes_effect(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    kind, passage = _corpus(spark, folder)
    of = lambda *names: {i for i, k in kind.items() if k in names}
    docs = table(spark, folder, "documents")
    left = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        left[name] = docs
        if number < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in left.items()}
    assert ids["quality_classifier"] == of("clean", "copy", "passage", "leak")
    assert ids["near_duplicates"] == ids["repeated_strings"] == of("clean", "passage", "leak")
    assert ids["benchmark_passages"] == ids["source_mix"] == of("clean", "passage")
    cut = {r.doc_id: r for r in left["repeated_strings"].collect()}
    before = {r.doc_id: r.text for r in left["near_duplicates"].collect()}
    assert all(passage not in cut[i].text and cut[i].n_chars == len(cut[i].text) for i in of("passage"))
    assert all(cut[i].text == before[i] for i in of("clean"))
    mixed = left["source_mix"].collect()
    assert abs(sum(r.taken for r in mixed) - 1.5 * sum(r.size for r in mixed)) <= 3
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids["source_mix"]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert {"op4_backoff", "op6_chat"} <= set(entry.oracle_sql())


def test_a_written_step_gives_its_tasks_few_rows_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    made = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long")
    assert sorted(r["n"] for r in written(made, "few-rows", 1000).collect()) == [500, 1000, 1000]
    assert spark.conf.get(option) == before
