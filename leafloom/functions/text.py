"""Text and vector expressions.  All but the counting of words by hash are built-in Spark columns, so they stay inside
generated code."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word budgets of the three summary levels.
LEVELS = {"gist": 15, "synopsis": 60, "digest": 200}
BUDGETS = {"gist": 20, "synopsis": 80, "digest": 300}
SNIPPET_CHARS, EVIDENCE_CHARS = 200, 360
SCHEME = "doc"
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
#: Latin letters and their plain forms, for slugs.
_PLAIN = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł", "n": "ñńņňŉ", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž"}
_FROM = "".join(_PLAIN.values())
_TO = "".join(k * len(v) for k, v in _PLAIN.items())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(title: Column, fallback: str = "section") -> Column:
    """Lower case, Latin letters without marks, other runs to one hyphen; ``fallback`` where nothing is left."""
    low = F.translate(F.lower(title), _FROM, _TO)
    low = F.replace(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    kept = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(kept == "", F.lit(fallback)).otherwise(kept)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """0 for an empty text, else 1.3 tokens a word, rounded down, at least 1."""
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.size(words(text)) * F.lit(1.3)).cast("int")))


def payload_tokens(*strings: Column) -> Column:
    """The estimate over all strings of a payload."""
    return token_estimate(F.concat_ws(" ", *strings))


def in_scope(section_id: Column, scope: str | None) -> Column:
    """The section itself or one below it; every section without a scope."""
    return F.lit(True) if scope is None else (section_id == scope) | section_id.startswith(f"{scope}/")


def anchor(doc_id: Column, section_id: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), doc_id.cast("string"), F.lit("/"), section_id)


def section_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(title, F.char(F.lit(0)), body), 256)


def cache_key(model: Column, level: Column, own_hash: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", model, level, own_hash), 256)


def embedding_text(title: Column, body: Column) -> Column:
    return F.when(F.trim(body) == "", title).otherwise(F.concat(title, F.lit("\n\n"), F.trim(body)))


def summary(title: Column, body: Column, level: str) -> Column:
    """The offline summary: the first words of the body, with an ellipsis where it was cut."""
    n = LEVELS[level]
    blank = F.when(F.trim(title) == "", F.lit("Section.")).otherwise(F.concat(F.trim(title), F.lit(".")))
    cut = lambda w: F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit("…")).otherwise(F.lit("")))
    return let(words(body), lambda w: F.when(F.size(w) == 0, blank).otherwise(cut(w)))


def within_budget(text: Column, level: str) -> Column:
    """The text itself within the level's budget, else its first words with an ellipsis."""
    n = BUDGETS[level]
    cut = lambda w: F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("…"))
    return let(text, lambda t: let(words(t), lambda w: F.when(F.size(w) <= n, t).otherwise(cut(w))))


def head(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET_CHARS)


def normalized(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 joined by one space."""
    return F.array_join(search_tokens(text), " ")


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bucket_counts(texts: Iterable[str | None], dim: int, known: dict[str, int]) -> Iterator[np.ndarray | None]:
    """Counts of words by hash bucket of each text in turn: no more than one text's words are held.  ``known`` remembers the
    buckets of words."""

    def place(word: str) -> int:
        if word not in known:
            if len(known) > 200_000:
                known.clear()
            known[word] = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big") % dim
        return known[word]

    for t in texts:
        yield None if t is None else np.bincount([place(w) for w in _SPACES.split(t) if w] or [place("__empty__")], minlength=dim).astype(float)


def hash_counts(text: Column, dim: int) -> Column:
    """Words of a text by hash bucket, the first eight bytes of the word's SHA-256 modulo ``dim``: one pass over the words in
    an Arrow function; a worker hashes a word once while it remembers it."""
    known: dict[str, int] = {}

    @F.pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(list(bucket_counts(texts, dim, known)), dtype=object)

    return counted(F.lower(text))


def hash_embedding(text: Column, dim: int) -> Column:
    """The offline embedding: counts of words by hash bucket, to unit length."""
    return unit(hash_counts(text, dim))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    return let(v, lambda w: let(norm(w), lambda n: F.when(n == 0, w).otherwise(F.transform(w, lambda x: x / n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def occurrences(text: Column, term: Column) -> Column:
    """How often a non-empty term occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def rendered(title: Column, body: Column) -> Column:
    return F.when(F.trim(body) == "", F.concat(F.lit("## "), title)).otherwise(F.concat(F.lit("## "), title, F.lit("\n\n"), body))


def numeric_prefix(title: Column) -> Column:
    found = F.regexp_extract(title, r"^\s*([0-9]+(?:\.[0-9]+)*)\b", 1)
    return F.when(found != "", found)


def source_locale(source: Column, known: list[str]) -> Column:
    """The first path segment that is a locale, as its language."""
    parts = F.transform(F.split(source, "/"), lambda p: F.replace(F.lower(p), F.lit("_"), F.lit("-")))
    base = lambda p: F.when(p.isin(*known), p).otherwise(F.regexp_extract(p, "^([a-z]{2})(?:-[a-z0-9]{2,8})+$", 1))
    return F.get(F.filter(F.transform(parts, base), lambda p: p.isin(*known)), 0)


def evidence(text: Column, terms: list[str]) -> Column:
    """The window of the text with most term occurrences: struct of text, matched_terms, start, end.

    Windows begin at 0 and 120 characters before each occurrence; the smallest start wins a tie.  The cleaned text is bound
    once and cut into chunks of a window's size, so a window costs two chunks wherever it lies.
    """
    size = EVIDENCE_CHARS

    def begins(low: Column, term: str) -> Column:
        """A little before each occurrence: the pieces between occurrences give their places."""
        def summed(sizes: Column) -> Column:
            seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            step = lambda a, n: F.struct((a["at"] + n + len(term)).alias("at"), F.array_append(a["out"], F.greatest(F.lit(0), a["at"] + n - size // 3)).alias("out"))
            return F.aggregate(F.slice(sizes, F.lit(1), F.size(sizes) - 1), seed, step)["out"]

        return let(F.transform(F.split(low, rf"\Q{term}\E", -1), lambda p: F.length(p)), summed)

    def over(clean: Column, low: Column, chunks: Column) -> Column:
        def window(s: Column) -> Column:
            k = F.floor(s / size).cast("int")
            two = F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit("")))
            return F.substring(two, s - k * size + 1, F.lit(size))

        score = lambda w: sum((occurrences(w, F.lit(t)) for t in terms), F.lit(0).cast("long"))
        starts = F.concat(F.array(F.lit(0)), *[begins(low, t) for t in terms])
        best = F.negative(F.array_max(F.transform(F.array_distinct(starts), lambda s: F.struct(let(window(s), score).alias("n"), F.negative(s).alias("s"))))["s"])

        def shown(at: Column) -> Column:
            end = F.least(F.length(clean), at + size)
            cut = F.substring(clean, at + 1, F.lit(size))
            out = F.when(at > 0, F.concat(F.lit("..."), F.ltrim(cut))).otherwise(cut)
            out = F.when(end < F.length(clean), F.concat(F.rtrim(out), F.lit("..."))).otherwise(out)
            matched = let(window(at), lambda w: F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(w, t)))
            return F.struct(out.alias("text"), matched.alias("matched_terms"), at.alias("start"), end.alias("end"))

        return let(best, shown)

    chunked = lambda low: F.regexp_extract_all(low, F.lit("(?s).{1,%d}" % size), F.lit(0))
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    return let(clean, lambda c: let(F.lower(c), lambda low: let(chunked(low), lambda chunks: over(c, low, chunks))))
