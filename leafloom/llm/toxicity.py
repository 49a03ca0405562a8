"""Operator 4: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's log-odds are a fixed background plus the weights of its distinct words
and word beginnings (4 to 6 letters; insults are inflected); the document is toxic if any sentence is (noisy-or:
1 - prod((1 - p) / (1 - p0)), p0 being the background's probability, so sentences without evidence add nothing at any
length).  Only documents carry labels; the weights are fitted through the noisy-or, and then tell which sentences offend.

The classifier is fitted on the driver on a bounded sample of labelled rows (``most_positive``, ``most_negative``: the
rows with the smallest hash of doc_id; of these whole texts in the order of a hash up to ``most_bytes``); scores are
computed for all whole texts in one pass without a shuffle.

Defined results: null and empty texts have no sentence and score 0; with no usable label, or labels of one class only,
no word has a weight; labels that are null or given twice for a doc_id are used once each if not null; repeated rows are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm._common import arrow_schema, documents, small_batches, text_of
from leafloom.llm.pretoken import LETTER, NUMBER, classes, in_parts, parts_of
from leafloom.llm.textscan import codepoints, runs, span_hashes

SCORED = "doc_id long, score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>"
#: What ends a sentence.
STOPS = [ord(c) for c in ".!?\n"] + [0x3002, 0xFF01, 0xFF1F]
FOLDS, HELD_OUT = 5, 0
BEGINNINGS = (4, 5, 6)
LEAST_GAIN, LEAST_RATIO = 4.0, 2.0

_LOWER: np.ndarray | None = None


def _lower() -> np.ndarray:
    global _LOWER
    if _LOWER is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x3000):
            low = chr(cp).lower()
            if len(low) == 1:
                table[cp] = ord(low)
        _LOWER = table
    return _LOWER


@dataclass
class Bags:
    """Words of texts by sentence: ``word_key`` and ``word_sentence``; of each sentence its text and span."""

    word_key: np.ndarray
    word_sentence: np.ndarray
    sentence_doc: np.ndarray
    sentence_start: np.ndarray
    sentence_end: np.ndarray


def bags(texts: list[str | None]) -> Bags:
    """Sentences are runs without a stop that hold a word; words are runs of letters and digits, in lower case."""
    cps, docs = codepoints(texts)
    if not len(cps):
        none = np.zeros(0, np.int64)
        return Bags(np.zeros(0, np.uint64), none, none, none, none)
    low = _lower()[cps]
    kind = classes()[cps]
    starts, ends = runs((kind == LETTER) | (kind == NUMBER), docs)
    s, e = runs(~np.isin(cps, np.array(STOPS, np.uint32)), docs)
    word_sentence = np.searchsorted(s, starts, "right") - 1
    has, word_sentence = np.unique(word_sentence, return_inverse=True)
    s, e = s[has], e[has]
    doc = np.searchsorted(docs, s, "right") - 1
    keys, places = [span_hashes(low, starts, ends)], [word_sentence]
    for k in BEGINNINGS:
        long = ends - starts > k
        keys.append(span_hashes(low, starts[long], starts[long] + k) ^ np.uint64(k))
        places.append(word_sentence[long])
    return Bags(np.concatenate(keys), np.concatenate(places), doc, s - docs[doc], e - docs[doc])


@dataclass
class Model:
    """Weights by word key (sorted), and the log-odds of a sentence without any of them."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    background: float = -9.0

    def __post_init__(self):
        self.filter = np.zeros(1 << 16, bool)  # by the upper bits of a key
        self.filter[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def log_odds(self, bag: Bags) -> np.ndarray:
        """Of each sentence."""
        if not len(self.keys):
            return np.full(len(bag.sentence_doc), self.background)
        likely = np.flatnonzero(self.filter[(bag.word_key >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, bag.word_key[likely]), len(self.keys) - 1)
        hit = self.keys[at] == bag.word_key[likely]
        pairs = np.unique(bag.word_sentence[likely[hit]] * len(self.keys) + at[hit])  # a word counts once in a sentence
        return self.background + np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], minlength=len(bag.sentence_doc))

    def scores(self, bag: Bags, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of each text's evidence (a sentence without any adds nothing, so length alone tells nothing), and each
        sentence's own probability."""
        z = self.log_odds(bag)
        clear = np.bincount(bag.sentence_doc, np.logaddexp(0, z) - np.logaddexp(0, self.background), minlength=n)
        return -np.expm1(-clear), 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(texts: list[str | None], toxic: np.ndarray, most_words: int = 2000, least: int = 3, rounds: int = 200, ridge: float = 0.05) -> Model:
    """Weights of the words that tell most, by gradient steps on the noisy-or likelihood (Adam).

    Only evidence for toxicity is used: words found in at least ``least`` documents that are over ``LEAST_RATIO`` times as
    likely in a toxic document as in another (smoothed, so the sample's balance doesn't matter), and of those the
    ``most_words`` with the largest gain (over ``LEAST_GAIN``); weights are never negative.
    """
    model, n = Model(), len(texts)
    toxic = np.asarray(toxic, float)
    if n == 0 or toxic.min() == toxic.max():
        return model
    parts = list(in_parts(texts, 300_000))  # small parts: the driver holds little beside the counts
    keys, total, pos = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j in parts:  # documents by word, part by part
        bag = bags(texts[i:j])
        own, word = np.unique(bag.word_key, return_inverse=True)
        pair = np.unique(word.astype(np.int64) * (j - i) + bag.sentence_doc[bag.word_sentence])
        word, doc = pair // (j - i), pair % (j - i)
        counts = [np.bincount(word, minlength=len(own)), np.bincount(word, toxic[i + doc], minlength=len(own)).astype(np.int64)]
        keys, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
        total, pos = (np.bincount(at, np.concatenate([x, y]), minlength=len(keys)).astype(np.int64) for x, y in zip((total, pos), counts, strict=True))
    rate = toxic.mean()

    def entropy(k, m, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (m * p)), 0) + np.where(m - k > 0, (m - k) * np.log((m - k) / (m * (1 - p))), 0)

    n_pos = toxic.sum()
    likelier = (pos + 0.5) / (n_pos + 1) > LEAST_RATIO * (total - pos + 0.5) / (n - n_pos + 1)
    gain = np.where((total >= least) & likelier, entropy(pos, np.maximum(total, 1), rate), -1)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:most_words])
    chosen = keys[chosen[gain[chosen] > LEAST_GAIN]]
    if not len(chosen):
        return model
    pairs, docs_of, before = [], [], 0
    for i, j in parts:  # sentences that hold a chosen word; the others add nothing
        bag = bags(texts[i:j])
        at = np.minimum(np.searchsorted(chosen, bag.word_key), len(chosen) - 1)
        hit = chosen[at] == bag.word_key
        pairs.append(np.unique((before + bag.word_sentence[hit].astype(np.int64)) * len(chosen) + at[hit]))
        docs_of.append(i + bag.sentence_doc)
        before += len(bag.sentence_doc)
    pair = np.concatenate(pairs)
    feature, sentence = pair % len(chosen), pair // len(chosen)
    own, sentence = np.unique(sentence, return_inverse=True)
    doc = np.concatenate(docs_of)[own]
    plain = np.logaddexp(0, model.background)
    weights, m1, m2 = np.ones(len(chosen)), np.zeros(len(chosen)), np.zeros(len(chosen))
    balance = np.where(toxic > 0, 0.5 / rate, 0.5 / (1 - rate))
    for t in range(1, rounds + 1):
        z = model.background + np.bincount(sentence, weights[feature], minlength=len(own))
        clear = np.bincount(doc, np.logaddexp(0, z) - plain, minlength=n)
        pull = np.where(toxic > 0, -1 / np.expm1(np.clip(clear, plain, 50)), 1.0) * balance
        grad = np.bincount(feature, (pull[doc] / (1 + np.exp(-np.clip(z, -50, 50))))[sentence], minlength=len(chosen)) + ridge * weights
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        weights = np.maximum(0, weights - 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8))
    return Model(chosen, weights, model.background)


def training_rows(docs: DataFrame, labels: DataFrame, most_positive: int, most_negative: int) -> DataFrame:
    """The bounded sample: text and toxic of labelled rows outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold != HELD_OUT)).select("doc_id", "toxic").distinct()
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c, most in ((1, most_positive), (0, most_negative))]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most most_positive + most_negative rows
    return docs.select("doc_id", text_of().alias("text")).join(picked, "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_negative: int = 4000, most_bytes: int = 200_000_000) -> Model:
    """Fits on the bounded sample: rows by the first two limits (a doc_id may stand for several rows, at most twice as
    many are taken), whole texts up to ``most_bytes`` in all."""
    rows = training_rows(docs, labels, most_positive, most_negative).withColumn("order", F.xxhash64("text", "toxic"))
    rows = rows.orderBy("order").limit(2 * (most_positive + most_negative))
    held = F.sum(F.octet_length("text")).over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, 0))  # over the limited rows
    found = rows.withColumn("held", held).where(F.col("held") <= most_bytes).select("text", "toxic").toArrow()
    return fit(found.column("text").to_pylist(), found.column("toxic").to_numpy())


def _scored(model: Model, least: float):
    schema = arrow_schema(SCORED)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in parts_of(batch.column(1)):
                bag = bags(texts)
                score, sentence = model.scores(bag, b - a)
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                for k in np.flatnonzero(sentence >= least).tolist():
                    spans[bag.sentence_doc[k]].append({"start": int(bag.sentence_start[k]), "end": int(bag.sentence_end[k]), "score": float(sentence[k])})
                n = np.bincount(bag.sentence_doc, minlength=b - a)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(score), pa.array(n), pa.array(spans, schema.field("offending").type)], schema=schema)

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, score, n_sentences and the spans of sentences whose own probability is ``least`` or more."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_scored(model, least), SCORED)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``limit`` or more; all columns stay, null texts stay."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for a, b, texts in parts_of(batch.column(place)):
                keep[a:b] = model.scores(bags(texts), b - a)[0] < limit
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
