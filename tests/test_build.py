from pathlib import Path

import pytest

from leafloom import schema
from leafloom.operators import index
from leafloom.plans import build, producers, tools
from leafloom.session import ship
from leafloom.sources import files


def test_build_of_a_repository(spark, tmp_path):
    spark = ship(spark)
    root = tmp_path / "repo"
    put = lambda name, data: (Path(root, name).parent.mkdir(parents=True, exist_ok=True), Path(root, name).write_bytes(data))
    put("a.md", b"# One\n\nThe `TenantStore`. See [two](#two).\n\n# Two\n\nTenantStore again.\n")
    put("bad.md", b"# X\n\xff\xfe\n")
    put("page.html", b"<h1>Page</h1><p>Hi</p>")
    put("blank.txt", b"  \n")
    put("sheet.xlsx", b"PK")
    put("node_modules/x.md", b"# no\n")
    store = files.Store(spark, str(tmp_path / "store"))
    config = files.RepoConfig(include=("**/*",), convert=True)
    log = {r.source: (r.rebuilt, r.ok, r.error) for r in build.sync(spark, str(root), store, config).collect()}
    assert log == {
        "a.md": (True, True, None), "bad.md": (False, False, "not valid UTF-8"), "page.html": (True, True, None),
        "blank.txt": (False, False, "nothing left after conversion"), "sheet.xlsx": (False, False, "no reader: sheet.xlsx"),
    }
    read = lambda name: store.read(name, build.TABLES[name]).collect()
    ids = {(r.doc_id, r.section_id) for r in read("sections")}
    assert ids == {("a", "one"), ("a", "two"), ("page", "page")}
    for name in ("summaries", "vectors"):
        assert {(r.doc_id, r.section_id) for r in read(name)} == ids
    assert {r.canonical for r in read("entity_hits")} >= {"TenantStore"} and ("one", "two", "link") in {(r.src, r.dst, r.kind) for r in read("xrefs")}

    # only what changed is built again; a document that lost its rows has none left
    put("a.md", b"no heading any more\n")
    log = {r.source: r.rebuilt for r in build.sync(spark, str(root), store, config).collect()}
    assert log["a.md"] and not log["page.html"]
    assert {r.doc_id for n in build.TABLES for r in read(n)} == {"page"}
    Path(root, "page.html").unlink()
    found = build.readable(files.discover(spark, str(root), config))
    states = {r.id: (r.state, r.title) for r in build.list_documents(found, store).collect()}
    assert states["a"] == ("indexed", None) and states["page"] == ("orphaned", "Page") and states["bad"][0] == "error"


def test_nothing_to_build_is_an_error(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.bin").write_bytes(b"x")
    with pytest.raises(schema.InvalidConfig):
        build.sync(spark, str(tmp_path / "repo"), files.Store(spark, str(tmp_path / "store")))


def repository(tmp_path, **texts):
    root = tmp_path / "repo"
    root.mkdir(exist_ok=True)
    for name, text in texts.items():
        (root / f"{name}.md").write_text(text)
    return str(root)


def test_what_a_producer_cannot_do_stays_with_its_document(spark, tmp_path):
    spark = ship(spark)
    root = repository(tmp_path, a="# A\n\nfine\n", b="# B\n\nbroken\n", c="# C\n\nfine too\n")
    store = files.Store(spark, str(tmp_path / "store"))

    def summarize(texts):
        if any("broken" in t for t in texts):
            raise RuntimeError("no answer")
        return ["said"] * len(texts)

    def extract(sections):
        if sections[0]["title"] == "C":
            raise KeyError("c")
        return [{"hit_ord": s["pos"], "section_id": s["section_id"], "canonical": s["title"], "surface_form": s["title"], "kind": "term", "span": {"start": 0, "end": 1}} for s in sections]

    producers.register("summarizer", "fragile", producers.summarizer_of(summarize, "fragile-model", levels=("gist", "synopsis")))
    hit = schema.ENTITY_HITS
    producers.register("entity_extractor", "fragile", producers.per_document(extract, hit))
    use = producers.Producers(summarizer="fragile", entity_extractor="fragile")
    log = {r.source: (r.rebuilt, r.ok, r.error) for r in build.sync(spark, root, store, use=use).collect()}
    assert log["a.md"] == (True, True, None)
    assert log["b.md"] == (False, False, "summarizer: RuntimeError: no answer") and log["c.md"][2].startswith("entity_extractor: KeyError")
    for name in (*build.TABLES, "records"):
        assert {r.doc_id for r in store.read(name, build.TABLES.get(name, "doc_id string")).collect()} <= {"a"}
    assert {(r.gist, r.digest, r.model) for r in store.read("summaries", schema.SUMMARIES).collect()} == {("said", None, "fragile-model")}
    # a document that fails keeps what was built before
    good = build.sync(spark, root, store).collect()
    assert all(r.ok and r.rebuilt for r in good)
    repository(tmp_path, b="# New B\n\nbroken again\n")
    log = {r.source: r.ok for r in build.sync(spark, root, store, use=producers.Producers(summarizer="fragile")).collect()}
    assert log == {"a.md": True, "b.md": False, "c.md": True}
    assert {r.title for r in store.read("sections", schema.SECTIONS).where("doc_id = 'b'").collect()} == {"B"}


def test_trees_that_are_not_well_formed_are_not_written(spark, tmp_path):
    root = repository(tmp_path, a="# Foo\n\n# Foo\n\n# Foo 2\n", b="# Bar\n")
    store = files.Store(ship(spark), str(tmp_path / "store"))
    log = {r.source: (r.ok, r.error) for r in build.sync(spark, root, store).collect()}
    assert log["a.md"] == (False, "tree: duplicate id foo-2") and log["b.md"] == (True, None)
    assert {r.doc_id for r in store.read("sections", schema.SECTIONS).collect()} == {"b"}


def test_the_build_writes_the_search_index(spark, tmp_path):
    root = repository(tmp_path, a="# Install\n\nHow to install the engine.\n", b="# Login\n\nTokens and sessions.\n")
    store = files.Store(ship(spark), str(tmp_path / "store"))
    build.sync(spark, root, store)
    asked = spark.createDataFrame([("q", "installing")], "query_id string, question string")
    best = index.search(index.Index(store.snapshot()), asked, 1).first()
    assert (best.doc_id, best.section_id, best.matched_terms) == ("a", "install", ["installing"])
    version = store.version()
    build.sync(spark, root, store)
    assert store.version() == version  # nothing to build, nothing written
    repository(tmp_path, a="# Removed\n\nNothing here.\n")
    build.sync(spark, root, store)
    best = index.search(index.Index(store.snapshot()), asked, 1).first()
    assert best.base_score == 0 or best.matched_terms == []


def test_other_producers_build_again_and_unknown_ones_are_refused(spark, tmp_path):
    root = repository(tmp_path, a="# A\n\n# B\n")
    store = files.Store(ship(spark), str(tmp_path / "store"))
    build.sync(spark, root, store)
    use = producers.Producers(xref_extractor="consecutive")
    assert [r.rebuilt for r in build.sync(spark, root, store, use=use).collect()] == [True]
    assert {(r.src, r.dst) for r in store.read("xrefs", schema.XREFS).collect()} == {("a", "b")}
    assert [r.rebuilt for r in build.sync(spark, root, store, use=use).collect()] == [False]
    with pytest.raises(schema.InvalidConfig):
        build.sync(spark, root, store, force=True, use=producers.Producers(summarizer="nobody"))
    with pytest.raises(schema.InvalidConfig):
        producers.register("cook", "x", lambda rows: rows)


def test_tools_over_a_built_repository(spark, tmp_path):
    spark = ship(spark)
    root = repository(
        tmp_path, a="# Install\n\nHow to install `TokenStore`.\n\n## Login\n\nSee [usage](#usage).\n\n## Usage\n\nRun it.\n", b="# Sessions\n\nThe `TokenStore` keeps them.\n", c="# Other\n\nNothing here.\n",
    )
    store = files.Store(spark, str(tmp_path / "store"))
    build.sync(spark, root, store)
    repository(tmp_path, c="# Other\n\nChanged.\n", d="# New\n")
    found = build.readable(files.discover(spark, root, files.RepoConfig()))
    space = tools.Workspace(store, found)
    assert {(r.id, r.state) for r in space.documents().collect()} == {("a", "indexed"), ("b", "indexed"), ("c", "stale"), ("d", "missing")}
    assert [(r.id, r.guidance) for r in space.documents("missing").collect()] == [("d", tools.GUIDANCE["missing"])]
    pack = space.context("install login", k=2, related_k=2, sections_per_doc=2)
    rows = pack.sections.orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2] and (rows[0].doc_id, rows[0].section_id) == ("a", "install") and rows[0].anchor == "doc://a/install"
    nodes = {(r.kind, r.id) for r in pack.nodes.collect()}
    assert {("document", "doc:a"), ("section", "section:a:install"), ("section", "section:a:install/login")} <= nodes
    edges = {(r.source, r.target, r.kind) for r in pack.edges.collect()}
    assert ("doc:a", "section:a:install", "contains") in edges and ("section:a:install", "section:a:install/login", "child") in edges
    assert all({("document", e[0]), ("section", e[0])} & nodes and ("section", e[1]) in nodes for e in edges)
    assert [r.id for r in pack.stale.collect()] == ["c"] and pack.skipped.count() == 0
    assert {(r.doc_id, tuple(r.dims)) for r in space.context("install", vector=[1.0] * 8).skipped.collect()} == {("a", (64,)), ("b", (64,)), ("c", (64,))}
    impact = space.document_impact("a")
    assert [(r.doc_id, r.shared) for r in impact["related_documents"].collect()] == [("b", 1)]
    counts = {r.table: r.rows for r in impact["artifacts"].collect()}
    assert counts["sections"] == counts["summaries"] == counts["records"] == 3 and counts["manifest"] == 1 and counts["postings"] > 3
    for call in (lambda: space.documents("lost"), lambda: space.search(" "), lambda: space.search("x", k=40), lambda: space.context("x", related_k=13), lambda: tools.Workspace(store).documents()):
        with pytest.raises(schema.InvalidInput):
            call()
