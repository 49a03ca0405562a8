import math
import random
import re

import pytest
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import query as Q
from leafloom.functions import text as T
from leafloom.operators import entities, evaluate, graph, lifecycle, search, tree, vectors, xrefs
from leafloom.session import ship
from leafloom.sources import markdown

DOC = "# 1 Intro\n\nThe `TenantStore` holds **Tenant Data**. See [api](#api) and Section 2.1.\n\n## Usage\n\nCall `TenantStore` for Tenant Data.\n\n# 2 Reference\n\n## 2.1 API\n\nTenant data here. Tenantstore. with Acme Cloud Labs.\n\n## API\n\nempty\n"


@pytest.fixture(scope="module")
def sections(spark):
    docs = ship(spark).createDataFrame([("d", DOC), ("e", "# Other\n\nTenant Data in Acme Cloud Labs.\n")], "doc_id string, text string")
    return markdown.parse(docs).cache()


def test_entities(sections):
    found = entities.hits(sections)
    body = {(r.doc_id, r.section_id): r.raw_text for r in sections.collect()}
    rows = found.collect()
    assert rows and all(body[r.doc_id, r.section_id][r.span.start : r.span.end] == r.surface_form for r in rows)
    names = {(r.doc_id, r.canonical, r.kind) for r in entities.fold(found).collect()}
    assert ("d", "TenantStore", "code") in names and ("d", "Tenant Data", "defined") in names and ("d", "Acme Cloud Labs", "proper") in names
    assert not any(r.surface_form == "Tenantstore" for r in rows)
    folded = entities.fold(found)
    assert entities.find_mentions(folded, sections, "tenant data").where("doc_id = 'd'").count() == 3
    assert entities.find_mentions(folded, sections, "nothing").count() == 0


def test_xrefs(sections):
    folded = entities.fold(entities.hits(sections))
    rows = {(r.src, r.dst, r.kind): r for r in xrefs.extract(sections, folded).where("doc_id = 'd'").collect()}
    assert rows["1-intro", "2-reference/api", "link"].confidence == 0.95
    assert ("1-intro", "2-reference/2-1-api", "textual") in rows
    shared = rows["1-intro", "1-intro/usage", "entity"]
    assert shared.confidence == pytest.approx(0.5)
    raw = sections.where("section_id = '1-intro'").first().raw_text
    link, text = rows["1-intro", "2-reference/api", "link"].span, rows["1-intro", "2-reference/2-1-api", "textual"].span
    assert raw[link.start : link.end] == "api" and raw[text.start : text.end] == "2.1"


def test_tree_queries(sections):
    s = tree.build_summaries(sections)
    assert [r.section_id for r in tree.outline(sections, 1).where("doc_id = 'd'").orderBy("pos").collect()] == ["1-intro", "2-reference"]
    assert tree.outline(sections, 1, "2-reference").collect()[0].truncated
    one = tree.get_section(sections, s, "d", "1-intro", "gist").first()
    assert one.has_children and one.next_levels == ["synopsis", "digest", "full"]
    with pytest.raises(schema.NotFound):
        tree.get_section(sections, s, "d", "nope")
    full = tree.read_range(sections, "d", "1-intro", "2-reference/api", 20).collect()
    assert full[0].section_id == "1-intro" and full[0].next_id is not None
    with pytest.raises(schema.InvalidInput):
        tree.outline(sections, 7)
    assert [r.section_id for r in tree.ancestors(sections, "d", "2-reference/api").collect()] == ["2-reference"]
    hit = tree.search_keyword(sections, ["Tenant", "api"], mode="all").first()
    assert hit.section_id == "1-intro" and hit.score == 2 * 6 + 3 * hit["counts"][1]


def test_vectors(sections):
    v = vectors.build(sections, 16).cache()
    assert vectors.check(v, sections, 16).count() == 0
    q = v.where("section_id = 'other'").first().vector
    best = vectors.nearest(v, q, 2).first()
    assert best.section_id == "other" and best.score == pytest.approx(1.0)
    found = vectors.search_semantic(v, sections, q, "tenant data", 3)
    assert found.first().evidence.matched_terms == ["tenant", "data"]
    with pytest.raises(schema.BuildFailed):
        vectors.nearest(v, q, 2, scope="Bad Scope")


def test_hash_embedding_formula(spark):
    import hashlib

    words = "the cat the dog é".split()
    want = [0.0] * 50
    for w in words:
        want[int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big") % 50] += 1
    size = math.sqrt(sum(x * x for x in want))
    got = spark.createDataFrame([("The cat  the DOG é",)], "t string").select(T.hash_embedding(F.col("t"), 50).alias("v")).first().v
    assert got == pytest.approx([x / size for x in want])


def test_search(sections, spark):
    src = spark.createDataFrame([("d", "docs/d.md", 0), ("e", "de/CHANGES.md", 1)], "doc_id string, source string, doc_ord int")
    v = vectors.build(sections, 16)
    recs = search.records(sections, v, tree.build_summaries(sections), src).cache()
    folded = entities.fold(entities.hits(sections))
    edges = search.graph_edges(sections, xrefs.extract(sections, folded), folded)
    top = search.search_documents(recs, "tenant data usage", [1.0] + [0.0] * 15, edges, k=4, sections_per_doc=2).collect()
    assert top[0].doc_id == "d" and len({r.doc_id for r in top[:2]}) == 2 and all(0 <= r.score <= 1.05 for r in top)
    assert len(search.search_documents(recs, "tenant", k=4).collect()) == 2
    short = search.shortlist(recs, search.Signals(Q.parse("tenant"), 5, 10.0, {"tenant": 3}), None, 1, 1, edges)
    assert 0 < short.count() <= recs.count()


def test_graph_denominator_counts_all_neighbours(spark):
    cols = "doc_id string, section_id string, base_score double, vector_score double, lexical_score double, sparse_score double, identity_bonus double, rank_factor double"
    scored = spark.createDataFrame([("d", "a", 0.5, 0.0, 0.5, 0.0, 0.0, 1.0), ("d", "b", 0.8, 0.0, 0.8, 0.0, 0.0, 1.0)], cols)
    edges = spark.createDataFrame([("d", "a", "d", "b", 0.5), ("d", "a", "d", "gone", 0.5)], "doc_id string, section_id string, n_doc string, n_section string, weight double")
    row = search.propagate(scored, edges).where("section_id = 'a'").first()
    assert row.graph_score == pytest.approx(0.4) and row.score == pytest.approx(0.25 * 0.9 + 0.04)


def test_query_language():
    assert Q.search_terms("how to install uv") == ["install", "to", "uv"]
    assert Q.variants("policies") == ["policies", "policie", "policy"]
    assert "evaluation" in Q.variants("evals") and Q.variants("uv") == ["uv"]
    assert Q.command_phrases("run the uv pip sync") == ["uv pip sync", "uv pip", "pip sync"]
    assert Q.phrase_weight("uv pip") == 6.0 and Q.query_locale("привет") is None and Q.preferred_locales(["zh_CN", "xx"], "a") == ["zh"]
    assert Q.query_terms("中文检索")[0] == "中文检索" and Q.parse("what changed in release").wants_history


def test_graph_and_impact(sections, spark):
    folded = entities.fold(entities.hits(sections))
    refs = xrefs.extract(sections, folded)
    src = spark.createDataFrame([("d", "d.md", 0), ("e", "e.md", 1)], "doc_id string, source string, doc_ord int")
    nodes, edges = graph.repo_graph(sections, src, refs, folded, 4, 5)
    stats = graph.graph_stats(nodes, edges).first()
    assert stats.documents == 2 and stats.sections == 4 and stats.entities > 0
    assert graph.related_documents(folded, "d", src).first().doc_id == "e"
    hit = graph.section_impact(sections, refs, folded, "d", "1-intro").collect()
    assert {r.kind for r in hit} >= {"child", "xref", "shared_entity"}
    assert {r.doc_id for r in graph.affected_documents(graph.section_impact(sections, refs, folded, "d", "2-reference/2-1-api"), "d").collect()} == {"d", "e"}
    hits = spark.createDataFrame([("d", "1-intro", 0.9), ("e", "other", 0.8)], "doc_id string, section_id string, score double")
    ctx = graph.context(hits, sections, tree.build_summaries(sections), refs).collect()
    assert [r["rank"] for r in ctx] == [1, 2] and len(ctx[0].related) == 3
    assert graph.related(sections, refs, "d", "1-intro", ("child", "sibling")).count() == 1
    assert graph.inspector_payload(nodes, edges).count() == nodes.count() + edges.count()


def test_evidence_against_plain_version(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(30)] + ["", "   ", "alphaalphaalpha"]
    terms = ["alpha", "zeta"]

    def plain(text):
        clean = text.strip()
        low, starts = clean.lower(), {0}
        for t in terms:
            starts |= {max(0, m.start() - 120) for m in re.finditer(t, low)}
        best = max(starts, key=lambda s: (sum(low[s : s + 360].count(t) for t in terms), -s))
        return best, min(len(clean), best + 360)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.evidence(F.col("t"), terms).alias("e")).collect()
    assert {r.i: (r.e.start, r.e.end) for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_lifecycle(spark):
    found = spark.createDataFrame([("a", "a.md", "1", None), ("b", "b.md", "2", None), ("c", "c.md", "3", None), ("x", "x.pdf", None, "bad")], "id string, source string, source_hash string, error string")
    old = spark.createDataFrame([("a", "1", 3, None), ("b", "0", 2, None), ("z", "9", 1, None)], "id string, indexed_hash string, section_count int, indexed_at timestamp")
    rows = lifecycle.status(found, old)
    assert {r.id: r.state for r in rows.collect()} == {"a": "indexed", "b": "stale", "c": "missing", "x": "error", "z": "orphaned"}
    n = lifecycle.counters(rows).first()
    assert (n.total, n.readiness) == (4, 0) and lifecycle.primary(rows).first().id == "a" and lifecycle.primary(rows, "b").first().id == "a"
    assert {r.id for r in lifecycle.changed(found, old).collect()} == {"b", "c", "x"}


def test_evaluation(spark):
    docs = spark.createDataFrame([("d", "one two  three\nfour é five"), ("n", "")], "doc_id string, text string")
    rows = evaluate.chunks(docs, 2).orderBy("chunk").collect()
    assert [r.text for r in rows] == ["one two", "three\nfour", "é five"] and rows[2].start == 20
    r = spark.createDataFrame([(["a/b", "c"], ["b", "z"]), (["x"], [])], "got array<string>, want array<string>").select(evaluate.recall(F.col("got"), F.col("want")).alias("r")).collect()
    assert [x.r for x in r] == [0.5, 1.0]
    rates = evaluate.hit_rates(spark.createDataFrame([(1, True), (4, True), (None, False)], "rank int, drilldown boolean"))
    got = {r.gate: r.passed for r in evaluate.gates(rates, {"top1": 0.3, "top5": 0.9}).collect()}
    assert got == {"top1": True, "top5": False}


def test_slug_and_estimates(spark):
    row = spark.createDataFrame([("Größe & Café!", "中文", "a b c", "")], "a string, b string, c string, e string")
    got = row.select(T.slug(F.col("a")), T.slug(F.col("b")), T.token_estimate(F.col("c")), T.token_estimate(F.col("e"))).first()
    assert list(got) == ["grosse-cafe", "section", 3, 0]
