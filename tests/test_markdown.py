import pytest

from leafloom import schema
from leafloom.operators import tree
from leafloom.session import ship
from leafloom.sources import files, markdown

SIMPLE = "# Introduction\n\nHello.\n\n## Quickstart\n\nRun it.\n\n## Configuration\n\nSet it.\n\n# Reference\n\n## API\n\nCall é it.\n"
NESTED = "# Top\n\n## Examples\n\n## Examples\n\n### Deep\n\n# Other\n\n## Examples\n"


def parse(spark, text):
    docs = ship(spark).createDataFrame([("d", text)], "doc_id string, text string")
    return markdown.parse(docs)


def test_simple_tree(spark):
    rows = parse(spark, SIMPLE).orderBy("pos").collect()
    assert [r.section_id for r in rows] == ["introduction", "introduction/quickstart", "introduction/configuration", "reference", "reference/api"]
    assert [r.parent for r in rows] == [None, "introduction", "introduction", None, "reference"]
    assert rows[0].children == ["introduction/quickstart", "introduction/configuration"]
    assert rows[4].path == ["Reference", "API"] and rows[4].raw_text == "\nCall é it.\n"
    raw = SIMPLE.encode()
    assert raw[rows[0].span.start : rows[0].span.end].decode().startswith("# Introduction") and raw[rows[0].span.end :].startswith(b"# Reference")


def test_duplicate_siblings(spark):
    rows = parse(spark, NESTED).orderBy("pos").collect()
    assert [r.section_id for r in rows] == ["top", "top/examples", "top/examples-2", "top/examples-2/deep", "other", "other/examples"]


def test_headings_of_many_forms():
    text = "---\na: 1\n---\nTitle `x_y`\n===\n\n```\n# no\n```\n~~~\n# no\n~~~\n#### Four ####\npara\n---\n#nope\n\n> # quoted\n- item\n---\n| a |\n|---|\n"
    assert [(a, b) for a, b, _, _ in markdown.headings(text)] == [(1, "Title x_y"), (4, "Four"), (2, "para"), (1, "quoted")]
    assert markdown.headings("") == [] and markdown.headings("two\n\nparagraphs") == []
    assert markdown.headings("# **Bold** and [link](u)")[0][1] == "Bold and link"


def test_validation_finds_clashing_counter(spark):
    rows = parse(spark, "# A\n## Foo\n## Foo\n## Foo 2\n")
    assert [r.problem for r in tree.validate(rows).collect()] == ["duplicate id"]


def test_discovery(spark, tmp_path):
    for name in ("README.md", "docs/guide.md", "docs/private/x.md", "A B.md", "a-b.md", "a.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# Hi")
    found = files.discover(spark, str(tmp_path), files.RepoConfig(exclude=("private/**",))).orderBy("source").collect()
    assert [(r.source, r.id) for r in found] == [("A B.md", "a-b"), ("README.md", "readme"), ("a-b.md", "a-b-2"), ("docs/guide.md", "docs-guide")]
    assert files.read_markdown(files.discover(spark, str(tmp_path), files.RepoConfig())).count() == 5


def test_document_ids_skip_ids_in_use(spark, tmp_path):
    names = ["A.md", "a-2.md", "a-4.md", "a.md", "b.md", "B.md", "b-2.md", "\u4e2d.md", "\u56fd.md"]
    want, used = {}, set()
    for name in sorted(names):
        base = name[:-3].lower() if name[0].isascii() else "document"
        own, k = base, 2
        while own in used:
            own, k = f"{base}-{k}", k + 1
        used.add(own)
        want[name] = own
    got = files.document_ids(spark.createDataFrame([(n,) for n in names], "source string")).collect()
    assert {r.source: r.id for r in got} == want and len(set(want.values())) == len(names)
    assert files.parser_of("x/Y.MD") == "markdown" and files.parser_of("a.pdf") == "pdf" and files.parser_of("a.html") == "converted"
    with pytest.raises(schema.InvalidConfig):
        files.parser_of("a.exe")
    for name in ("node_modules/x/a.md", "docs/build/b.md", "docs/c.md", ".venv/d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# Hi")
    assert [r.source for r in files.discover(spark, str(tmp_path), files.RepoConfig()).collect()] == ["docs/c.md"]


def test_config_round_trip(tmp_path):
    config = files.RepoConfig(exclude=("x/**",), sections_per_doc=3, primary_doc="readme")
    files.write_config(str(tmp_path), config)
    assert files.load_config(str(tmp_path)) == config and files.find_root(str(tmp_path / "a" / "b")) == str(tmp_path)
    assert files.Settings.load({"LOOM_EMBED_BATCH": "7"}).embed_batch == 7


def test_pages(spark):
    pages = spark.createDataFrame([("p", 1, "Intro text"), ("p", 2, "Second é"), ("q", 1, "only")], "doc_id string, page int, text string")
    toc = spark.createDataFrame([("p", 0, 1, "One", 1), ("p", 1, 9, "Two", 2), ("p", 2, 1, " ", 2)], "doc_id string, ord int, level int, title string, page int")
    rows = {r.section_id: r for r in files.pages_to_sections(pages, toc).collect()}
    assert set(rows) == {"one", "one/two", "document"} and rows["one/two"].raw_text == "Second é" and rows["one/two"].level == 6
    spans = spark.createDataFrame([("p", 1, 0, 20.0, "Intro"), ("p", 1, 1, 10.0, "text"), ("p", 2, 0, 10.0, "Second é")], "doc_id string, page int, ord int, size double, text string")
    assert {r.section_id for r in files.pages_to_sections(pages, None, spans).collect()} == {"intro", "document"}


def test_convert(spark):
    html = "<h1>Top</h1><p>One &amp; two</p><ul><li>x</li></ul>"
    found = spark.createDataFrame([("a", "a/my_page.html", bytearray(html.encode())), ("b", "notes.txt", bytearray(b"hello"))], "id string, source string, content binary")
    rows = {r.doc_id: r for r in files.convert(found).collect()}
    assert rows["a"].text.startswith("# Top") and "One & two" in rows["a"].text
    assert rows["b"].text == "# notes\n\nhello" and len(rows["b"].source_hash) == 64


def test_store(spark, tmp_path):
    from leafloom import schema

    store = files.Store(spark, str(tmp_path))
    rows = parse(spark, SIMPLE)
    store.write("sections", rows)
    assert store.read("sections", schema.SECTIONS).count() == 5
    assert store.read("xrefs", schema.XREFS, optional=True).count() == 0
    store.write("sections", parse(spark, NESTED))
    assert store.read("sections", schema.SECTIONS).count() == 6 and store.consistent("sections", "sections")
