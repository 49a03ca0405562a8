import pytest
from pyspark.sql import functions as F

from leafloom.operators import evaluate, models
from leafloom.session import ship


@pytest.fixture(scope="module")
def sections(spark):
    return ship(spark).createDataFrame([("d", "a", "A", "one two"), ("d", "b", "B", "")], "doc_id string, section_id string, title string, raw_text string")


def test_summaries_use_the_cache(sections, spark):
    first = models.summarize(sections, "gist", lambda texts: ["word " * 30 for _ in texts], "m").cache()
    assert all(len(r.text.rstrip("…").split()) == 20 for r in first.collect())
    cache = first.where("section_id = 'a'").select("key", F.lit("kept").alias("text"))
    again = {r.section_id: r.text for r in models.summarize(sections, "gist", lambda texts: ["new"] * len(texts), "m", cache).collect()}
    assert again == {"a": "kept", "b": "new"}


def test_vectors_are_checked(sections):
    rows = models.embed(sections, lambda texts: [[3.0, 4.0]] * len(texts), 2).collect()
    assert rows[0].vector == pytest.approx([0.6, 0.8])
    assert {r.error for r in models.embed(sections, lambda texts: [[1.0]] * len(texts), 2).collect()} == {"a vector has another dimension"}


def test_calls_run_side_by_side_and_only_texts_at_fault_fail(spark):
    import time

    def slow(texts):
        time.sleep(0.1)
        if "bad" in texts:
            raise ValueError("bad")
        return [t.upper() for t in texts]

    texts = [f"t{k}" for k in range(40)]
    texts[17] = "bad"
    rows = ship(spark).createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    took = {}
    for workers in (1, 10):
        began = time.time()
        found = models.mapped(rows, "t", "out", "string", slow, 2, workers).collect()
        took[workers] = time.time() - began
        assert [r.k for r in found] == list(range(40)) and [r.out for r in found] == [None if t == "bad" else t.upper() for t in texts]
        assert [r.error for r in found if r.error] == ["ValueError: bad"]
    assert took[10] < took[1] / 2


def test_answers_are_kept_in_the_store(sections, spark, tmp_path):
    from leafloom.sources.store import Store

    store, calls = Store(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def call(texts):
        calls.add(len(texts))
        return ["short"] * len(texts)

    for _ in range(2):
        assert {(r.section_id, r.text) for r in models.cached_summaries(store, sections, "gist", call, "m").collect()} == {("a", "short"), ("b", "short")}
    assert calls.value == 2
    store.clear("summary_cache")
    models.cached_summaries(store, sections, "gist", call, "m").collect()
    assert calls.value == 4


def test_retries():
    class Busy(Exception):
        status = 429

    calls = []

    def call(texts):
        calls.append(1)
        if len(calls) < 3:
            raise Busy
        return texts

    assert models.retried(call, wait=0)(["x"]) == ["x"] and len(calls) == 3


def test_batch_answers_and_report(spark):
    rows = spark.createDataFrame([('```json\n{"items": [{"id": "a", "summary": "s"}]}\n```',)], "x string").select(models.batch_answers(F.col("x")).alias("i")).first()
    assert rows.i[0].id == "a" and rows.i[0].summary == "s"
    done = evaluate.bench_summary(spark.createDataFrame([("x", 0.5, 10), ("x", 1.0, 20)], "system string, recall double, tokens int"))
    assert "| x | 75.00% | 15 | 2 |" in evaluate.report(done)
    docs = spark.createDataFrame([("d", "cats and dogs " * 3), ("e", "trees and birds")], "doc_id string, text string")
    asked = spark.createDataFrame([("q", "trees birds")], "question_id string, question string")
    assert evaluate.baseline_hits(evaluate.chunks(docs, 5), asked, k=1).first().doc_id == "e"
