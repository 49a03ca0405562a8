import random
import re
from collections import defaultdict

import numpy as np
import pytest

from leafloom.llm import near_dedup, passages
from leafloom.llm._common import Scratch
from leafloom.llm.components import components
from leafloom.session import ship

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[doc] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed=1, n=140):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    bases = [[word() for _ in range(rng.randint(20, 60))] for _ in range(12)]
    rows = []
    for k in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randint(1, 40))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        rows.append((k * 7 + 3, " ".join(w).title() if rng.random() < 0.2 else " ".join(w)))
    return rows + [(5000, ""), (5001, None), (5002, "one"), (5003, "One"), (5004, "one two"), (5005, " \n ")]


@pytest.mark.parametrize("size,percent,bands,rows", [(3, 85, 25, 5), (5, 80, 32, 4)])
def test_components_against_brute_force(spark, size, percent, bands, rows):
    data = corpus()
    docs = ship(spark).createDataFrame([(a, b, 1) for a, b in data], "doc_id long, text string, component int")
    got = near_dedup.near_duplicates(docs, size, percent, bands, rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(data, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_buckets_and_blocks(spark, monkeypatch):
    """Blocks of buckets, and clusters over several blocks, give the same components."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    data = corpus(3, 90)
    docs = ship(spark).createDataFrame(data, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, 3, 85, 25, 5).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in plain_components(data, 3, 85).items()}


def test_odd_rows(spark):
    text = "a b c d e f g h i j k l m n o p"
    docs = ship(spark).createDataFrame([(7, text), (7, text), (None, text), (None, None), (9, text), (None, "alone in here now")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert rows == sorted([(7, 7, True), (7, 7, True), (None, 7, False), (None, None, True), (9, 7, False), (None, None, True)], key=str)
    assert sorted((r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()), key=str) == sorted([7, 7, None, None, None], key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_star_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for x in sorted(near):
        if x not in seen:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in seen:
                    seen.add(y)
                    want[y] = x
                    todo += near[y]
    df = spark.createDataFrame(edges, "u long, v long")
    rows = components(df, Scratch(spark, "t"), "c").collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert components(df.limit(0), Scratch(spark, "t"), "c").count() == 0


def test_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    passage = [word() for _ in range(52)]
    near = [w if k != 30 else "changed" for k, w in enumerate(passage)]
    fill = lambda n: [word() for _ in range(n)]
    rows = [(1, " ".join(fill(90) + passage + fill(33))), (2, " ".join(fill(7)) + "\n" + "\n".join(passage)), (3, " ".join(near + fill(5))), (4, " ".join(fill(400))), (5, None), (6, ""), (7, "few words"), (8, " ".join(["x"] * 300)), (None, " ".join(passage))]
    docs = ship(spark).createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, start int")
    got = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and {r.doc_id for r in got if not r.removed} == {1}
    for r in got:
        text = dict(rows)[r.doc_id]
        assert len(text[r.start : r.end].split()) == r.n_words >= 20
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_any_passage_of_fifty_words_holds_a_paragraph():
    import numpy as np

    rng = np.random.default_rng(3)
    passage = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    for k in range(200):
        words = np.concatenate([rng.integers(0, 1 << 62, k % 37).astype(np.uint64), passage, rng.integers(0, 1 << 62, k % 29).astype(np.uint64)])
        at = passages.anchors(words) - k % 37
        assert ((at >= 0) & (at + passages.LENGTH <= 50)).any()


def passage_rows(spark, rows):
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    return passages.repeated_passages(docs).collect()


def fresh(seed):
    rng = random.Random(seed)
    return rng, lambda n: ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]


def test_edited_paragraphs_and_short_exact_passages_are_found(spark):
    """Lines of 60 words with a changed word in the middle, and passages of 30 words inside lines, 60 pairs each."""
    rng, words = fresh(4)
    rows, edited = [], set()
    for k in range(60):
        line = words(60)
        near = line[:30] + words(1) + line[31:]
        rows += [(4 * k, "\n".join([" ".join(words(25)), " ".join(line)])), (4 * k + 1, "\n".join([" ".join(near), " ".join(words(25))]))]
        edited.add((4 * k + 1, 0, len(" ".join(near))))
        shared = words(30)
        rows += [(4 * k + 2, " ".join(words(rng.randint(0, 40)) + shared + words(40))), (4 * k + 3, " ".join(words(rng.randint(0, 40)) + shared + words(40)))]
    got = passage_rows(spark, rows)
    assert {r.doc_id for r in got if r.removed} == {d for k in range(60) for d in (4 * k + 1, 4 * k + 3)}
    assert edited <= {(r.doc_id, r.start, r.end) for r in got}


def test_similar_paragraphs_of_a_full_bucket_are_all_compared(spark, monkeypatch):
    """Families of two lines that share a frequent opening; blocks of four paragraphs."""
    monkeypatch.setattr(passages, "BLOCK", 4, raising=False)
    _, words = fresh(5)
    opening, rows = words(17), []
    for k in range(300):
        line = words(8)
        rows += [(2 * k, " ".join(opening + line)), (2 * k + 1, " ".join(opening + line[:-1] + words(1)))]
    got = passage_rows(spark, rows)
    whole = {(r.doc_id, r.component_id) for r in got if r.end == len(rows[r.doc_id][1]) and r.start == 0}
    assert len({d for d, _ in whole if d % 2}) == 300


def test_a_passage_inside_copies_keeps_its_text_and_links(spark):
    """Document 1 holds Q; 2 and 3 are copies of a text around Q: what is first in 2 stays there."""
    _, words = fresh(6)
    q, left, right = words(40), words(60), words(60)
    rows = [(1, " ".join(words(30) + q + words(30))), (2, " ".join(left + q + right)), (3, " ".join(left + q + right))]
    got = passage_rows(spark, rows)
    texts = dict(rows)
    taken = {d: [texts[d][r.start : r.end].split() for r in got if r.doc_id == d and r.removed] for d in (1, 2, 3)}
    assert taken == {1: [], 2: [q], 3: [left + q + right]}
    mine = {d: set().union(*(r.component_ids for r in got if r.doc_id == d)) for d in (1, 2, 3)}
    assert mine[1] and mine[1] < mine[2] and mine[2] == mine[3]


def test_the_whole_repeated_passage_is_reported(spark):
    rng, words = fresh(7)
    rows, want = [], {}
    for k in range(40):
        passage = words(rng.choice([30, 50, 60, 120]))
        for d in (2 * k, 2 * k + 1):
            a, b = words(rng.randint(0, 45)), words(rng.randint(0, 45))
            sep = rng.choice([" ", "\n", "  "])
            want[d] = sep.join(passage)
            rows.append((d, " ".join(a + [want[d]] + b)))
    got = passage_rows(spark, rows)
    assert {r.doc_id: dict(rows)[r.doc_id][r.start : r.end] for r in got} == want and len(got) == 80
    assert all(r.n_words == len(want[r.doc_id].split()) for r in got)


def test_sketches_bound_the_similarity_of_sets():
    """No pair that is similar enough is ruled out, of any sizes; hardly any that is far from it is left."""
    import numpy as np

    rng = np.random.default_rng(9)
    draw = lambda n: np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    sets = []
    for n in (1, 2, 15, 16, 17, 40, 63, 200, 3000, 20_000):
        for share in (0, 0.3, 0.7, 0.85, 0.9, 0.95, 1):
            common, k = draw(round(n * share)), n - round(n * share)
            sets += [(np.union1d(common, draw(k)), np.union1d(common, draw(k))), (np.union1d(common, draw(k)), common)]
    sets += [(draw(0), draw(0)), (draw(40), draw(0)), (np.arange(400, dtype=np.uint64) << np.uint64(14), np.arange(380, dtype=np.uint64) << np.uint64(14))]
    shared = np.array([len(np.intersect1d(a, b)) for a, b in sets])
    either = np.array([len(np.union1d(a, b)) for a, b in sets])
    left = passages.within_reach([passages.sketch(a) for a, _ in sets], [passages.sketch(b) for _, b in sets], 80)
    similar = 100 * shared >= 80 * either
    assert left[similar].all() and similar.sum() > 20
    far = (100 * shared < 40 * either) & (either > 100)
    assert not left[far].any() and far.sum() > 10
    assert len(passages.within_reach([], [], 80)) == 0


def test_texts_of_pairs_that_are_not_similar_stay(spark):
    """Groups of 15 lines that share buckets, as half of each is the same: what is shuffled is bounded by the texts, not the pairs."""
    _, words = fresh(10)
    rows = []
    for k in range(10):
        half = words(2000)
        rows += [(100 * k + j, " ".join(half + words(2000))) for j in range(15)]
    near = rows[0][1].split()
    near[3000] = "changed"
    rows.append((5000, " ".join(near)))
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        found = store.stageList(None, False, False, none, None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    joins = "spark.sql.autoBroadcastJoinThreshold"
    before, held = written(), spark.conf.get(joins)
    spark.conf.set(joins, "-1")
    try:
        got = passages.repeated_passages(docs).collect()
    finally:
        spark.conf.set(joins, held)
    moved = sum(n for k, n in written().items() if k not in before) / sum(len(t) for _, t in rows)
    whole = {r.doc_id: r.component_id for r in got if (r.start, r.end) == (0, len(dict(rows)[r.doc_id]))}
    assert whole.keys() >= {0, 5000} and whole[0] == whole[5000]
    assert moved < 8


def test_reach_of_many_equals_reach_of_pairs():
    rng = np.random.default_rng(4)
    sketches = [passages.sketch(rng.integers(0, 1 << 12, n).astype(np.uint64)) for n in (5, 20, 40, 41, 90, 200, 37, 39)]
    want = [[bool(passages.within_reach([x], [y], 60)[0]) for y in sketches] for x in sketches]
    assert passages.reach_matrix(sketches, sketches, 60).tolist() == want


def test_large_buckets_equal_all_pairs(spark, monkeypatch):
    """Families of lines that share an opening, and similar ones among them, in blocks and by all pairs of a bucket."""
    _, words = fresh(12)
    opening, rows = words(30), []
    for k in range(90):
        rows.append(opening + words(30))
        for _ in range(k % 3):
            rows.append(list(rows[-1]))
            rows[-1][45 + k % 10] = f"changed{k}"
    docs = ship(spark).createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = {}
    for small, block, wide in ((1 << 20, 256, 16), (4, 8, 2), (4, 16, 1)):
        for name, value in (("SMALL_BUCKET", small), ("BLOCK", block), ("WIDE", wide)):
            monkeypatch.setattr(passages, name, value)
        found[block] = sorted(tuple(r) for r in passages.repeated_passages(docs).collect())
    assert found[8] == found[16] == found[256] and len(found[8]) > 180


def test_a_family_with_one_opening_moves_its_sketches_only(spark):
    """Lines of 80 words that share their first 40 are in one bucket, and none is similar to another."""
    _, words = fresh(13)
    opening = words(40)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        found = store.stageList(None, False, False, none, None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    moved = {}
    for n in (800, 6400):
        rows = [(k, " ".join(opening + words(40))) for k in range(n)]
        docs = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
        before = written()
        got = passages.repeated_passages(docs).collect()
        moved[n] = sum(n for k, n in written().items() if k not in before) / sum(len(t) for _, t in rows)
        assert len({r.doc_id for r in got}) == n
    assert moved[6400] < 1.2 * moved[800], moved
