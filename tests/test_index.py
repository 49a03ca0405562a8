import random

import pytest
from pyspark.sql import functions as F

from leafloom.functions import query as Q
from leafloom.functions import text as T
from leafloom.operators import index as I
from leafloom.operators import search as S
from leafloom.operators import tree, vectors
from leafloom.session import ship
from leafloom.sources import markdown
from leafloom.sources.store import Store

WORDS = "install installer login token tokens config configure evaluate store stores stream changelog history uv add pip run the of repo graph section".split()
DIM = 16


def corpus(seed, n=25):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines.append("#" * rng.randint(1, 3) + " " + " ".join(rng.choices(WORDS, k=rng.randint(1, 3))).title())
            lines.append(" ".join(rng.choices(WORDS, k=rng.randint(0, 60))))
        out.append((f"doc-{k}", "\n\n".join(lines)))
    return out


SOURCES = ["docs/en/{}.md", "docs/fr/{}.md", "{}.md", "CONTRIBUTING.md", "changelog/{}.md", "guide/install-{}.md"]


def tables(spark, docs):
    rows = ship(spark).createDataFrame(docs, "doc_id string, text string")
    sections = markdown.parse(rows).persist()
    sources = spark.createDataFrame([(d, SOURCES[k % len(SOURCES)].format(d)) for k, (d, _) in enumerate(docs)], "doc_id string, source string")
    return sections, vectors.build(sections, DIM), tree.build_summaries(sections), sources


def written(spark, path, docs):
    store = Store(spark, path)
    sections, vecs, summaries, sources = tables(spark, docs)
    with store.commit() as commit:
        I.write(commit, sections, vecs, summaries, sources)
        commit.replaces(sections.select("doc_id"))
    return store


def full_pass(spark, docs, question, vector):
    """Scores of all records by the ranker without an index."""
    sections, vecs, summaries, sources = tables(spark, docs)
    recs = S.records(sections, vecs, summaries, sources.withColumn("doc_ord", F.lit(0))).persist()
    q = Q.parse(question)
    n, mean, df, cover = S.statistics(recs, q)
    return S.score(recs, S.Signals(S.weigh(q, n, cover), n, mean, df), vector)


def unit(spark, text):
    return spark.range(1).select(T.hash_embedding(F.lit(text), DIM).alias("v")).first().v


QUESTIONS = ["how to install the token store", "login", "uv add", "history of changes", "zzz qqq", "configure evaluation stream", "the"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = corpus(1)
    return docs, written(spark, str(tmp_path_factory.mktemp("index")), docs)


def test_scores_equal_the_ranker_without_an_index(spark, built):
    docs, store = built
    asked = [(f"q{k}", q, unit(spark, q)) for k, q in enumerate(QUESTIONS)]
    found = I.score(I.Index(store.snapshot()), spark.createDataFrame(asked, "query_id string, question string, vector array<double>"), k=8)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.doc_id, r.section_id] = r
    for key, question, vector in asked:
        want = {(r.doc_id, r.section_id): r for r in full_pass(spark, docs, question, vector).collect()}
        mine = got.get(key, {})
        for name, r in mine.items():
            for signal in ("vector_score", "lexical_score", "sparse_score", "identity_bonus", "rank_factor", "base_score"):
                assert getattr(r, signal) == pytest.approx(getattr(want[name], signal), abs=1e-9), (question, name, signal)
        best = sorted((r.base_score for r in want.values()), reverse=True)[:8]
        assert sorted((r.base_score for r in mine.values()), reverse=True)[:8] == pytest.approx(best, abs=1e-9)
        missing = [r.base_score for name, r in want.items() if name not in mine]
        assert not missing or max(missing) <= best[-1] + 1e-9


def test_search_is_diversified_like_the_ranker(spark, built):
    docs, store = built
    question = QUESTIONS[0]
    vector = unit(spark, question)
    sections, vecs, summaries, sources = tables(spark, docs)
    edges = S.graph_edges(sections)
    asked = spark.createDataFrame([("q", question, vector)], "query_id string, question string, vector array<double>")
    mine = I.search(I.Index(store.snapshot()), asked, k=6, sections_per_doc=2, edges=edges).orderBy("rank").collect()
    order = sources.withColumn("doc_ord", F.struct("source", "doc_id"))
    recs = S.records(sections, vecs, summaries, order)
    want = S.search_documents(recs, question, vector, edges, 6, 2).collect()
    assert [(r.doc_id, r.section_id) for r in mine] == [(r.doc_id, r.section_id) for r in want]
    assert [r.score for r in mine] == pytest.approx([r.score for r in want], abs=1e-9)
    assert [r.matched_terms for r in mine] == [r.matched_terms for r in want]


def test_sparse_top_by_blocks(spark, built, monkeypatch):
    docs, store = built
    for question in ("install token store", "the of repo", "zzz"):
        want = [round(r.sparse_score, 9) for r in full_pass(spark, docs, question, None).where("sparse_score > 0").orderBy(F.desc("sparse_score")).limit(7).collect()]
        got = I.bm25(I.Index(store.snapshot()), question, 7).collect()
        assert [round(r.sparse, 9) for r in got] == want


def test_a_changed_document_costs_its_own_rows(spark, tmp_path):
    docs = corpus(3, 12)
    store = written(spark, str(tmp_path / "s"), docs)
    before = I.Index(store.snapshot())
    new = [("doc-3", "# Install\n\nlogin login uv")]
    sections, vecs, summaries, _ = tables(spark, new)
    sources = spark.createDataFrame([("doc-3", "guide/install-doc-3.md")], "doc_id string, source string")
    with store.commit() as commit:
        I.write(commit, sections, vecs, summaries, sources)
        commit.replaces(sections.select("doc_id"))
    sizes = [s["bytes"] for s in store.snapshot().content["tables"]["postings"]]
    assert sizes[1] < sizes[0]
    changed = dict(docs) | dict(new)
    order = {d: SOURCES[k % len(SOURCES)].format(d) for k, (d, _) in enumerate(docs)} | {"doc-3": "guide/install-doc-3.md"}
    fresh = Store(spark, str(tmp_path / "fresh"))
    sections, vecs, summaries, _ = tables(spark, list(changed.items()))
    with fresh.commit() as commit:
        I.write(commit, sections, vecs, summaries, spark.createDataFrame(list(order.items()), "doc_id string, source string"))
    now, same = I.Index(store.snapshot()), I.Index(fresh.snapshot())
    assert before.signature != now.signature and now.statistics() == same.statistics()
    asked = spark.createDataFrame([("q", "install uv login")], "query_id string, question string")
    rows = lambda index: {(r.doc_id, r.section_id, round(r.base_score, 9)) for r in I.score(index, asked).collect()}
    want = rows(same)
    assert rows(now) == want
    assert I.compact(store, whole=True) == 4 and not store.snapshot().content["deletes"]
    assert rows(I.Index(store.snapshot())) == want


def scanned(spark, df):
    """Rows that the scans of a plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, stack = [], [plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().get("numOutputRows").get().value())
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return sum(found)


def test_a_scan_reads_the_blocks_of_its_tokens(spark, tmp_path):
    rows = ship(spark).range(60000).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("s").alias("section_id"), F.lit("x").alias("source"), F.concat(F.lit("t"), "id").alias("title"), F.lit(0).alias("pos"), F.concat(F.lit("common w"), F.col("id") % 20000).alias("raw_text"))
    store = Store(spark, str(tmp_path))
    with store.commit() as commit:
        I.write(commit, rows.drop("source"), None, None, rows.select("doc_id", "source"))
    index = I.Index(store.snapshot())
    everything = scanned(spark, index.blocks().select("token"))
    few = scanned(spark, index.blocks(["w77"]).select("token", "entries"))
    assert 1 <= few < everything / 4
    hot = index.blocks(["common"]).select(F.size("entries").alias("n")).collect()
    assert max(r.n for r in hot) <= I.BLOCK and sum(r.n for r in hot) == 60000
