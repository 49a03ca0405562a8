"""Work that must grow no faster than its input: plans, bounds and results at the places where it once did."""

import random
import tracemalloc

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import evaluate, index, search, tree, vectors
from leafloom.plans import adapters, markdown_queries
from leafloom.session import ship
from leafloom.sources import markdown
from leafloom.sources.store import Store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_territories_read_each_heading_once(spark):
    rng = random.Random(5)
    rows = [(d, k, rng.randint(1, 6), f"t{k}", 10 * k, 10 * k + 5, 10_000) for d in ("a", "b") for k in range(60)]
    found = markdown.assemble(spark.createDataFrame(rows, markdown.HEADINGS))
    assert "unboundedfollowing" not in plan_of(found)
    for r in found.collect():
        after = [x[4] for x in rows if x[0] == r.doc_id and x[1] > r.pos and x[2] <= r.level]
        assert r.terr_end == min(after, default=10_000)


def test_headings_are_dealt_by_the_bytes_of_their_texts(spark, monkeypatch):
    text = "# A\n\nx\n\n## B\n\ny\n\n## B\n\nz\n"
    docs = ship(spark).createDataFrame([(f"d{k}", text) for k in range(400)], "doc_id string, text string")
    monkeypatch.setattr(markdown, "TASK_BYTES", 400 * len(text) // 16 + 1, raising=False)
    found = markdown.parse(docs)
    plan = plan_of(found)
    assert plan.count("16), REPARTITION_BY_NUM") >= 4  # windows, children, bodies: alike rows are so small that others are merged
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 1200 and max(per_task) < 300
    ids = found.groupBy("section_id", "parent", "children", "raw_text").count().collect()
    assert {(r.section_id, r.parent, tuple(r.children), r.raw_text.strip(), r["count"]) for r in ids} == {("a", None, ("a/b", "a/b-2"), "x", 400), ("a/b", "a", (), "y", 400), ("a/b-2", "a", (), "z", 400)}
    assert markdown.parse(docs.limit(0)).count() == 0 and markdown.parse(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_edges_read_sections_that_are_parsed_once(spark, tmp_path):
    ship(spark).createDataFrame([(k, f"Text {k}") for k in range(30)] + [(30, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = markdown_queries.md_shared_edges(spark, str(tmp_path))
    assert "MapInArrow" not in plan_of(found) and found.count() == 31 * 12


def test_faults_are_found_in_one_pass(spark):
    ddl = "doc_id string, section_id string, parent string, children array<string>, level int, span struct<start:int,end:int>"
    good = ("d", "a", None, ["a/b"], 1, (0, 9))
    rows = [good, ("d", "a/b", "a", [], 2, (1, 9)), ("e", "a", None, None, 1, (0, 9)), ("e", "a", None, [], 1, (0, 9)), ("f", "x", "lost", ["gone", "x"], 1, (0, 1)), ("f", "y", "lost", [], 1, (0, 1)), ("g", " ", None, [], 7, (0, 1)), ("h", "z", None, [], None, (0, 1))]
    found = tree.validate(spark.createDataFrame(rows, ddl))
    assert plan_of(found).count("Scan ExistingRDD") == 1
    want = [("e", "a", "duplicate id"), ("f", "gone", "unknown child"), ("f", "lost", "unknown parent"), ("f", "lost", "unknown parent"), ("g", " ", "out of range")]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_equally_near_sections_come_by_id(spark):
    texts = ["bb cc cc", "aa aa aa"]  # with the title cc both have 3 / 10 of the question's cosine
    turns = [(d, k, f"turn-{k}", "cc", t, (0, 1), 1) for d, ts in (("d", texts), ("e", texts[::-1])) for k, t in enumerate(ts)]
    sections = ship(spark).createDataFrame(turns, "doc_id string, pos int, section_id string, title string, raw_text string, span struct<start:int,end:int>, level int")
    docs = spark.createDataFrame([(d, "bb cc") for d in "de"], "doc_id string, text string")
    questions = spark.createDataFrame([(f"q-{d}", d, "aa bb bb bb", ["turn-0"]) for d in "de"], "question_id string, doc_id string, question string, expected array<string>")
    found = evaluate.bench(docs, sections, tree.build_summaries(sections), questions, 64, 1, 32, ("head",)).where("system = 'engine'")
    assert [r.section_ids for r in found.collect()] == [["turn-0"], ["turn-0"]]


def test_tokens_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y", "x", "x"]), (1, "b", []), (2, "a", None), (2, "b", ["z"])], "doc_id long, section_id string, tokens array<string>")
    found = search.postings(rows)
    assert "Exchange" not in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", "x", 3), (1, "a", "y", 1), (2, "b", "z", 1)]
    assert {r.token: r.df for r in search.document_frequency(found).collect()} == {"x": 1, "y": 1, "z": 1}


def test_nearest_of_many_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_ROWS", 50)
    monkeypatch.setattr(vectors, "MOST_QUERIES", 10)
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(90)]
    rows = [("d", f"s{k:03}", base[k % 90]) for k in range(260)] + [("d", "a-zero", [0.0] * 5), ("d", "a-none", None), ("d", "a-short", [1.0]), ("d", "a-null", [1.0, None, 0.0, 0.0, 0.0]), ("d", "a-nan", [float("nan")] * 5)]
    asked = [(k, base[k]) for k in range(0, 90, 3)] + [(100, None), (101, [0.0] * 5), (102, [1.0, 2.0])]
    v = ship(spark).createDataFrame(rows, "doc_id string, section_id string, vector array<double>")
    q = spark.createDataFrame(asked, "query_id int, query array<double>")
    pairs = v.crossJoin(q).select("query_id", "doc_id", "section_id", T.clamp(T.dot(F.col("vector"), F.col("query"))).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "section_id", "doc_id")
    want = pairs.withColumn("rank", F.row_number().over(by)).where("rank <= 3")
    found = vectors.nearest_batch(v, q, 3)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.section_id, str(r.score)) for r in df.collect())
    assert rows_of(found) == rows_of(want)


def test_words_of_one_text_at_a_time(spark, tmp_path):
    tracemalloc.start()
    made = list(T.bucket_counts((" ".join(f"w{j}x{k}" for j in range(3000)) for k in range(60)), 64, {}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(m.sum() == 3000 for m in made) and peak < 40_000_000  # what it remembers, at most 200,000 words
    spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = adapters.table(spark, str(tmp_path), "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert [None if r.v is None else sum(r.v) for r in rows.orderBy("doc_id").select(T.hash_counts(F.col("text"), 8).alias("v")).collect()] == [1.0, None]


def test_the_rest_of_a_question_is_ranked_in_parts(spark, tmp_path):
    rows = ship(spark).range(300).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("s").alias("section_id"), F.lit("x").alias("source"), F.lit("t").alias("title"), F.lit(0).alias("pos"), F.lit("w").alias("raw_text"))
    store = Store(spark, str(tmp_path))
    with store.commit() as commit:
        index.write(commit, rows.withColumn("vector", F.array(F.lit(1.0).cast("float"))), None, None, None)
    found = index.score(index.Index(store.snapshot()), spark.createDataFrame([("q", "nothing", [1.0])], "query_id string, question string, vector array<double>"), k=5)
    assert "pmod(xxhash64(doc_id" in plan_of(found)
    assert {r.base_score for r in found.collect()} == {search.VECTOR_ONLY} and found.count() == 25


def test_postings_are_made_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 40)
    monkeypatch.setattr(index, "SLICE", 60)
    monkeypatch.setattr(index, "BLOCKS", 3)
    texts = ["aa bb aa cc " * k + f"z{k}" for k in range(12)] + [None, ""]
    rows = ship(spark).createDataFrame([(f"d{k}", "s", "x", "bb t", 0, t) for k, t in enumerate(texts)], "doc_id string, section_id string, source string, title string, pos int, raw_text string")
    for n, head in enumerate((None, (10, 25))):
        recs = index.records(rows.where("raw_text IS NOT NULL"), None, None, None, head)
        found = index.postings(recs)
        assert "Exchange" not in plan_of(recs) and "Exchange" not in plan_of(found)
        entries = found.select("token", "most_tf", "least_length", F.explode("entries").alias("e")).select("token", "most_tf", "least_length", "e.*").collect()
        assert all(r.tf <= r.most_tf and r.length >= r.least_length for r in entries)
        got = {(r.token, r.doc_id): (r.tf, r.length, r.fields) for r in entries}
        want = {}
        for k, t in enumerate(texts):
            if t is None:
                continue
            field, counted = [t[:m] for m in head or (1 << 30, 1 << 30)]
            words = [f"d{k}", "x", "bb", "t", "bb", "t", *counted.split()]
            for w in {*words, *field.split()}:
                bits = sum(1 << f for f, x in enumerate((f"d{k}", "x", "bb t", "", field)) if w in x.split())
                want[w, f"d{k}"] = (words.count(w), len(words), bits)
        assert got == want and len(entries) == len(want)
        store = Store(spark, f"{tmp_path}/{n}")
        with store.commit() as commit:
            index.write(commit, rows.where("raw_text IS NOT NULL"), None, None, None, head)
        asked = spark.createDataFrame([("q", "aa bb"), ("r", "z3 cc")], "query_id string, question string")
        few = sorted(map(str, index.score(index.Index(store.snapshot()), asked).collect()))
        with monkeypatch.context() as m:
            m.setattr(index, "FEW", 0)
            m.setattr(index, "WORDS", 0)
            assert sorted(map(str, index.score(index.Index(store.snapshot()), asked).collect())) == few


def test_few_words_meet_tokens_without_a_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "NAMED", 2)
    rows = ship(spark).createDataFrame([(f"d{k}", "s", "x", "t", 0, f"in{k} within under") for k in range(9)], "doc_id string, section_id string, source string, title string, pos int, raw_text string")
    store = Store(spark, str(tmp_path))
    with store.commit() as commit:
        index.write(commit, rows, None, None, None)
    found = index.hits(index.Index(store.snapshot()), index.parsed(spark.createDataFrame([("q", "within under")], "query_id string, question string")))
    assert "Join" not in plan_of(found)
    assert {(r.variant, r.token) for r in found.collect()} == {("within", "within"), ("under", "under")} and found.count() == 18
