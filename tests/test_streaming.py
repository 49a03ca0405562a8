from leafloom import schema
from leafloom.plans import build
from leafloom.session import ship
from leafloom.sources.files import Store
from leafloom.streaming import refresh


def test_refresh_keeps_the_newest_version(spark, tmp_path):
    store = Store(ship(spark), str(tmp_path / "store"))
    put = lambda rows: spark.createDataFrame(rows, refresh.SOURCE).write.mode("append").parquet(str(tmp_path / "in"))
    ids = lambda: sorted(r.section_id for r in store.read("sections", schema.SECTIONS).collect())

    def run(rows):
        put(rows)
        refresh.refresh(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
        return ids()

    assert run([("a", "# One\n", 1), ("a", "# Two\n\n## Sub\n", 2), ("b", "# Bee\n", 1)]) == ["bee", "two", "two/sub"]
    assert run([("b", "# New\n", 5)]) == ["new", "two", "two/sub"]
    before = store.version()
    assert run([("b", "# Old\n", 3)]) == ["new", "two", "two/sub"]  # comes late
    assert run([("b", "# New\n", 5)]) == ["new", "two", "two/sub"] and store.version() == before  # comes again
    assert run([("a", None, 4)]) == ["new"]
    assert run([("a", "# Two\n", 3)]) == ["new"]  # older than its deletion
    for name, ddl in build.TABLES.items():
        assert {r.doc_id for r in store.read(name, ddl).collect()} <= {"b"}
    assert {(r.doc_id, r.version, r.deleted) for r in store.read("versions", refresh.VERSIONS).collect()} == {("a", 4, True), ("b", 5, False)}
    assert run([("a", "# Back\n", 6)]) == ["back", "new"]
