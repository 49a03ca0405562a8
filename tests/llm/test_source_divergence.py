import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafloom.llm import source_divergence as D
from leafloom.session import ship

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["Apple", "apple", "été", "ÉTÉ", "中文", "x", "_", "a1b", "İ", "zeta", "Beta", "don't"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = [(" ".join(rng.choices(words[: rng.randint(3, len(words))], k=rng.randint(0, 25))), rng.choice(["en", "en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "é", None])) for _ in range(400)]
    rows += [(None, "en", "s9"), ("", "de", "a"), ("!!", "de", "b"), ("rare words", "xx", "only"), ("\x00a\x7fB\x80", "en", "s1")]
    return rows + rows[:3]


@pytest.mark.parametrize("size", [D.BUCKET_ROWS, 7])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(D, "BUCKET_ROWS", size)
    rows = corpus()
    df = ship(spark).createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, rank int").repartition(3)
    found = D.source_divergence(df).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found} == brute(rows)


def test_empty_table(spark):
    df = ship(spark).createDataFrame([], "doc_id long, text string, lang string, source string")
    assert D.source_divergence(df).count() == 0


def test_slices_with_equal_hashes_are_told_apart(monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda b: len(b) % 2)
    text, _, starts, ends = D.terms_of(np.frombuffer(b"aa bb aa cccc bb d e d", np.uint8), np.array([0, 22]))
    group, first = D.group_slices(text, starts, ends)
    pieces = [text[a:b] for a, b in zip(starts, ends)]
    assert [text[starts[first[g]] : ends[first[g]]] for g in group] == pieces
    assert len(set(group.tolist())) == 5


def test_terms_end_with_their_text():
    _, doc, starts, ends = D.terms_of(np.frombuffer("ab" "cé" "" "!x".encode(), np.uint8), np.array([0, 2, 5, 5, 7]))
    assert list(zip(doc.tolist(), starts.tolist(), ends.tolist())) == [(0, 0, 2), (1, 2, 5), (3, 6, 7)]


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    rows = corpus(9)
    df = ship(spark).createDataFrame(rows, "text string, lang string, source string")
    whole = {tuple(r) for r in D.term_counts(df).collect()}
    counter = D.Counter()
    for text, lang, source in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        counter.add([(lang or "", source or "")], raw, np.array([0, len(raw)]))
        counter.fold()
    schema = D.arrow_schema(D.COUNTS)
    assert {tuple(r.values()) for b in counter.rows(schema) for r in b.to_pylist()} == {(a, b, bytes(t), n, d) for a, b, t, n, d in whole}


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(500):
        total, size = rng.randrange(10**14), rng.randrange(1, 10**8)
        count = rng.randrange(total + 1)
        assert int(D.shares(np.array([count]), np.array([total]), size)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * size)
