import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from leafloom.llm import piece_codec
from leafloom.llm._common import tokenizer_file
from leafloom.session import ship

MODEL = "piece_bpe_32k.model"
LETTERS = "ab cd'sstrevell  \n\t  é中1²３!?-<|>_▁\x00😀�"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(MODEL))


@pytest.fixture(scope="module")
def own():
    return piece_codec.PieceCodec(tokenizer_file(MODEL), remembered=5000)


def hard_texts(own):
    rng = random.Random(11)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    out += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) for _ in range(1000)]
    out += ["".join(rng.choice(list(own.score)) for _ in range(rng.randint(1, 10))) for _ in range(2000)]
    out += ["".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(20)) for _ in range(300)]
    return out + ["", " ", "▁", "a" * 5000, "ab" * 3000, " " * 4000, "aab" * 9999, "é" * 9000, "<s>", "<0x41>", "</s> <unk>"]


def test_ids_and_texts_equal_the_library(own, library):
    for text in hard_texts(own):
        want = library.encode(text, add_bos=True, add_eos=True)
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want)


def test_any_ids_decode_as_the_library_does(own, library):
    rng = random.Random(3)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 9))]
        assert own.decode(np.array(ids, "<u4")) == library.decode(ids)


def test_backtracking_equals_plain_merging(own):
    rng = random.Random(8)
    for _ in range(1000):
        text = "▁" + "".join(rng.choice("thesinga▁") for _ in range(rng.randint(1, 30)))
        assert [own.letters(p) for p in own.pieces(text)] == own.merged(text)


def test_a_text_over_many_blocks(own, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "BLOCK", 16)
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aabeinrst") for _ in range(rng.randint(10, 300)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_documents(spark, library):
    rows = [(5, "hello world's", "x"), (1, None, "y"), (3, "", "z"), (None, "no id", "w"), (5, "hello world's", "x"), (9, "long " * 50000, "v"), (2, "中é\x00 a", "u")]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, ids string")
    model = tokenizer_file(MODEL)
    found = piece_codec.decode_pieces(piece_codec.encode_pieces(docs, model), model).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = [(r[0], len(i := library.encode(r[1] or "", add_bos=True, add_eos=True)), np.array(i, "<u4").tobytes(), library.decode(i)) for r in rows]
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in found], key=key) == sorted(want, key=key)
    assert piece_codec.encode_pieces(docs.limit(0), model).count() == 0


def test_query_gives_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in piece_codec.op11_piece_codec(spark, sf).collect():
        ids = library.encode(texts.pop(r.doc_id), add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not texts
