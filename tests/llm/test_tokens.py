import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from leafloom.llm import packing, pretoken, sharding, token_counts, token_output
from leafloom.llm._common import tokenizer_file
from leafloom.session import ship

LETTERS = "ab cd'sstrevell  \n\t  é中1²３!?-<|>_<|endoftext|>😀 'm 'll"
ROWS = [(5, "hello world's", "x"), (1, None, "y"), (3, "", "z"), (None, "no id", "w"), (5, "hello world's", "x"), (9, "long " * 5000, "v"), (2, "a<|endoftext|>b", "u")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def docs(spark):
    return ship(spark).createDataFrame(ROWS, "doc_id long, text string, slot string")


def hard_texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    out += ["".join(chr(rng.randrange(32, 0xD7FF)) for _ in range(20)) for _ in range(200)]
    out += ["".join(rng.choice(["'s", "'re", " ", "x", "'", "<|endoftext|>", "\n"]) for _ in range(12)) for _ in range(500)]
    return out + ["<|endoftext|>", "", None, "  ", "a" * 5000, "ab" * 3000, " " * 4000]


def test_encoder_and_transducer_equal_the_library(tokenizer):
    texts = hard_texts()
    ids, at = pretoken.Encoder(tokenizer_file()).encode(texts)
    n_bytes, n_tokens = token_counts.Transducer(tokenizer_file()).count(texts)
    for k, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert (n_bytes[k], n_tokens[k]) == (len((text or "").encode()), len(want))


def test_small_memory_gives_the_same(tokenizer):
    texts = hard_texts()[:300]
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    machine = token_counts.Transducer(tokenizer_file(), most_states=50)
    assert [int(machine.count([t])[1][0]) for t in texts] == want
    small = pretoken.Encoder(tokenizer_file(), limit=5)
    assert [int(small.encode([t])[1][1]) for t in texts] == want


def test_rans_round_trip_checkpoints_and_checksums():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 20_001).clip(1, 50_000).astype(np.uint32)
    tokens, counts = np.unique(ids, return_counts=True)
    freqs = token_output.Table.scaled(counts)
    assert freqs.min() >= 1 and freqs.sum() == 1 << token_output.SCALE
    table = token_output.Table(tokens, freqs)
    for part in (ids, ids[:1], ids[:7], np.repeat(ids[:1], 3000)):
        block = token_output.encode_block(part, table, lanes=64, every=16) | {"n_tokens": len(part)}
        assert (token_output.decode_block(block, table) == part).all()
        for a, b in ((0, 1), (len(part) // 2, len(part)), (max(0, len(part) - 3), len(part))):
            assert (token_output.decode_block(block, table, a, b) == part[a:b]).all()
    block["words"] = block["words"][:-1] + b"x" if block["words"] else b"x"
    with pytest.raises(ValueError):
        token_output.decode_block(block, table)
    with pytest.raises(ValueError):
        token_output.encode_block(np.array([0], np.uint32), table)


def test_token_files(spark, docs, tokenizer, tmp_path):
    path = f"file://{tmp_path}/files"
    token_output.write_token_files(docs, path, tokenizer_file(), block_tokens=50, shards=3)
    rows = sorted(token_output.read_token_files(spark, path).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for row, (doc, text, _) in zip(rows, order, strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    path = f"file://{tmp_path}/none"
    token_output.write_token_files(none, path, tokenizer_file())
    assert token_output.read_token_files(spark, path).count() == 0
    assert packing.pack_documents(none, tokenizer_file()).count() == 0
    assert token_counts.count_tokens(none, tokenizer_file()).count() == 0
    schema = sharding.write_shards(none, f"file://{tmp_path}/shards")
    assert sharding.read_shards(spark, f"file://{tmp_path}/shards", schema).count() == 0


def test_packing(docs, tokenizer):
    rows = packing.pack_documents(docs.coalesce(1), tokenizer_file(), size=64, open_bins=3).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 9)
    total = len(tokenizer.encode("long " * 5000, add_special_tokens=False).ids) + 1
    assert sum(n for _, _, n in long) == total and all(n == 64 for _, _, n in long[1:]) and [s for _, s, _ in long] == [sum(x[2] for x in long[:k]) for k in range(len(long))]
    assert sum(r.length for r in rows if r.doc_id == 1) == 1


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.add("a", 6) == [] and bins.add("b", 7) == []
    assert bins.add("c", 8) == [["c"]]  # three are open: the fullest closes
    assert bins.add("d", 3) == [["b", "d"]] and bins.add("e", 10) == [["e"]] and bins.rest() == [["a"]]


def plain_packer(pieces, size, most):
    """Bounded-space best-fit by looking at every open sequence."""
    closed, opened = [], []
    for name, length in pieces:
        if length == size:
            closed.append([name])
            continue
        fit = [b for b in opened if b["free"] >= length]
        own = min(reversed(fit), key=lambda b: b["free"]) if fit else {"free": size, "names": []}
        if fit:
            opened.remove(own)
        own["names"].append(name)
        own["free"] -= length
        if own["free"] == 0:
            closed.append(own["names"])
            continue
        opened.append(own)
        if len(opened) > most:
            fullest = min(reversed(opened), key=lambda b: b["free"])
            opened.remove(fullest)
            closed.append(fullest["names"])
    return closed, [b["names"] for b in opened]


def test_open_bins_equal_a_plain_packer():
    rng = random.Random(3)
    for size, most in ((20, 1), (50, 3), (2048, 512), (100, 40)):
        pieces = [(k, min(size, int(rng.expovariate(3 / size)) + 1)) for k in range(2000)]
        bins, closed = packing.OpenBins(size, most), []
        for name, length in pieces:
            closed += bins.add(name, length)
        want, rest = plain_packer(pieces, size, most)
        assert closed == want and sorted(map(sorted, bins.rest())) == sorted(map(sorted, rest))


def test_later_turns_have_no_more_open_sequences(spark, monkeypatch):
    """All pieces are placed once, each turn with bounded space, whatever the number of tasks."""
    most = []
    add = packing.OpenBins.__init__
    monkeypatch.setattr(packing.OpenBins, "__init__", lambda self, size, bound: (most.append(bound), add(self, size, bound))[1])
    docs = ship(spark).createDataFrame([(k, "word " * (k * 7 % 40), "x") for k in range(400)], "doc_id long, text string, slot string")
    rows = packing.pack_documents(docs.repartition(16), tokenizer_file(), size=64, open_bins=5, pool=60).collect()
    assert sorted(r.doc_id for r in rows if r.piece == 0) == list(range(400))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    tokens = sum(r.length for r in rows)
    assert len(places) <= 1.1 * -(-tokens // 64) + 10
    assert set(most) <= {5}


def test_offsets_by_groups_of_buckets(spark, tmp_path, monkeypatch):
    docs = ship(spark).createDataFrame([(k, f"text {k}" * (k % 9), "x") for k in range(300)], "doc_id long, text string, slot string")
    found = {}
    for group in (1, 3, 1024):
        monkeypatch.setattr(sharding, "GROUP", group)
        path = f"file://{tmp_path}/{group}"
        rows = sharding.read_shards(spark, path, sharding.write_shards(docs, path, shards=7, bucket_bytes=100)).collect()
        found[group] = sorted((r.shard, r.slot, r.record.doc_id) for r in rows)
    assert found[1] == found[3] == found[1024]
    assert [(s, k) for s, k, _ in found[1]] == [(s, k) for s in range(7) for k in range(43 if s < 6 else 42)]


def test_sharding(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    schema = sharding.write_shards(docs, path, shards=4, bucket_bytes=200)
    rows = sharding.read_shards(spark, path, schema).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, sizes.values())) == [1, 2, 2, 2] and all(sorted(v) == list(range(len(v))) for v in sizes.values())
    assert sorted((r.record.doc_id or -1, r.record.slot) for r in rows) == sorted((a or -1, c) for a, _, c in ROWS)
    again = f"file://{tmp_path}/again"
    sharding.write_shards(docs.repartition(3), again, shards=4, bucket_bytes=200)
    key = lambda rs: sorted((r.shard, r.slot, r.record.text or "") for r in rs)
    assert key(sharding.read_shards(spark, again, schema).collect()) == key(rows)


def test_token_counts_of_odd_rows(spark, docs, tokenizer):
    rows = token_counts.count_tokens(docs, tokenizer_file(), 5).collect()
    want = [(i or 0, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in rows) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 5) for r in rows)
    clash = docs.withColumnRenamed("slot", "n_tokens").withColumn("n_bytes", docs.doc_id)
    assert token_counts.count_tokens(clash, tokenizer_file()).count() == len(ROWS)
