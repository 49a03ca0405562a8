import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    text = lambda n=60: " ".join(word() for _ in range(n)) + "."
    item = text(40)
    rows = [(k, text() + (" grumbus." if k % 4 == 0 else ""), "en", "s", 1) for k in range(80)]
    rows += [(100, rows[1][1], "en", "s", 1), (101, text() + " " + item, "en", "s", 1), (102, text() + " token = abcdefghijklmnop", "en", "s", 1), (103, None, None, None, None), (104, "", "", "", 0)]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_take_effect_and_keep_clean_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = {k for k in range(80) if k % 4} | {103, 104}
    assert set(seen["toxicity"]) == clean | {100, 101, 102}
    assert set(seen["near_dedup"]) == clean | {101, 102}
    assert set(seen["decontamination"]) == clean | {102} == set(seen["secrets"])
    assert seen["secrets"][102].text.endswith("[SECRET]") and seen["secrets"][1].text == seen["toxicity"][1].text
    assert set(seen["packing"]) == clean | {102}
    assert corpus_pipeline.run(spark, folder).count() == len(seen["packing"])


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
