"""Operator 2: secret scans with a randomness test battery, in SQL functions only.

Base rules find assignments, access keys and hex runs by pattern.  The method then looks at all other runs of 12 key
characters or more, and where such a run holds signs also at its parts between them.  For each it infers the encoding
(the smallest alphabet that holds it) and tests the null hypothesis that it is structured text written in that alphabet:

* uniformity: chi-squared of the characters' counts against the encoding's alphabet;
* runs: changes between the encoding's character classes (cases, digits and signs; vowels and consonants for letters);
* serial correlation of neighbouring character codes.

Each alphabet has its own rates of text (ENCODINGS); those of random strings follow from the alphabet's size and classes.
The three scores are combined (Stouffer) by their power at this length, which is how far the two hypotheses lie apart.  A
string that does not fit a random one either (4 standard deviations in any test) is no candidate for discovery.
Benjamini-Hochberg controls the false discovery rate over all candidates of the corpus within each stratum of encoding
and length, so short strings, of which the tests can tell little, need more evidence.  Only the histogram of the p-values
comes to the driver (its size is fixed).

Work is linear in a text's length and matches, but for a term of the square of the matches over 256.

Defined results: null texts are empty; offsets are code points, ends exclusive; runs that hold an access or hex span or
run into the key of an assignment are not reported, nor parts of a reported run; equal starts are ordered as KINDS;
repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, documents, text_of

#: The base patterns.  The length limits of access and hex are part of the pattern (a run that is too short
#: holds no other match); that of assign is applied to its second group afterwards.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
RUN, PART = r"[A-Za-z0-9+/_=-]{12,}", r"[A-Za-z0-9]{12,}"
#: By encoding: pattern, alphabet, classes; of written language and identifiers in it the chance that two characters are
#: equal, the rate of class changes, and the serial correlation.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
VOWELS = "AEIOUaeiou"
ENCODINGS = [
    ("decimal", "^[0-9]+$", DIGITS, [DIGITS], 0.13, 0.0, 0.2),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", [DIGITS, "abcdefABCDEF"], 0.12, 0.15, 0.2),
    ("letters", "^(?:[a-z]+|[A-Z]+)$", LOWER, [VOWELS, "".join(c for c in UPPER + LOWER if c not in VOWELS)], 0.066, 0.6, 0.0),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567", [UPPER, DIGITS, "="], 0.065, 0.08, 0.3),
    ("one case", "^(?:[a-z0-9]+|[A-Z0-9]+)$", LOWER + DIGITS, [UPPER + LOWER, DIGITS], 0.055, 0.15, 0.35),
    ("two cases", "^[A-Za-z]+$", UPPER + LOWER, [UPPER, LOWER], 0.055, 0.38, 0.3),
    ("alphanumeric", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, [UPPER, LOWER, DIGITS], 0.055, 0.38, 0.3),
    ("base64", "", UPPER + LOWER + DIGITS + "+/", [UPPER, LOWER, DIGITS, "+/_=-"], 0.055, 0.35, 0.3),
]
#: Names vary more than independent characters would: standard deviations under the null are this much larger.
DISPERSION, FIT = 1.3, 4.0
LENGTH_BANDS = (16, 20, 24, 32, 40, 64, 128)
BINS, BLOCK = 300, 256
SPANS = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, largest: bool = False) -> Column:
    """For each place of an array (a bound value) the sum, or the largest (0 at least), of the values before it, by blocks."""
    join = (lambda a, x: F.greatest(a, x)) if largest else (lambda a, x: a + x)
    fold = lambda v: F.aggregate(v, F.lit(0), join)
    part = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: fold(part(b)))

    def within(sums: Column) -> Column:
        def one(_, b):
            seed = F.struct(fold(F.slice(sums, F.lit(1), b)).alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(part(b), seed, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

        return F.flatten(F.transform(sums, one))

    return F.when(F.size(values) > 0, let(blocks, within)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, build: Callable[[Column, Column], Column], kind: str) -> Column:
    """``build(match, start)`` of all matches, of the SQL type ``array<kind>``.

    The pieces between matches and the matches together are the text, so their lengths give the offsets.
    """
    split = lambda: F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(found: Column) -> Column:
        def starts(gaps: Column) -> Column:
            moved = F.transform(found, lambda m, i: F.get(gaps, i) + F.length(m))
            return let(moved, lambda v: F.zip_with(before(v), gaps, lambda a, g: a + g))

        return F.when(F.size(found) > 0, F.zip_with(found, F.slice(let(split(), starts), F.lit(1), F.size(found)), build)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end) of all matches; ``keep`` may test the match."""

    def build(m, at):
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("end"))
        return span if keep is None else F.when(keep(m), span)

    return F.filter(matches(text, pattern, build, SPANS[6:-1]), lambda s: s.isNotNull())


def base_spans(text: Column) -> Column:
    """Sorted spans of the base rules."""
    assign = spans_of(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE)
    return F.array_sort(F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, to about three digits."""
    x = F.abs(z)
    q = F.exp(-x * x / 2) / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51)) / 2.5066282746
    return F.when(z > 0, q).otherwise(1 - q)


def encoding_of(token: Column) -> Column:
    out = F.when(token.rlike(ENCODINGS[0][1]), 0)
    for k, (_, pattern, *_) in enumerate(ENCODINGS[1:-1], 1):
        out = out.when(token.rlike(pattern), k)
    return out.otherwise(len(ENCODINGS) - 1)


def rates() -> list[tuple[float, ...]]:
    """By encoding: alphabet size, the chance of equal characters in text, class changes in text and in random strings, and
    the serial correlation of text."""
    out = []
    for _, _, alphabet, classes, equal, change, serial in ENCODINGS:
        shares = [sum(c in own for c in alphabet) / len(alphabet) for own in classes]
        out.append((float(len(alphabet)), equal, change, 1 - sum(s * s for s in shares), serial))
    return out


def p_value(n: Column, code: Column, squares: Column, changes: Column, serial: Column) -> Column:
    """The battery's p-value for a string of ``n`` characters: ``squares`` is the sum of the squared character counts."""
    size, equal, text_rate, random_rate, text_serial = (F.get(F.array(*[F.lit(r[k]) for r in rates()]), code) for k in range(5))
    chi = squares * size / n - n
    chi_text, chi_text_sd = size * (1 + (n - 1) * equal) - n, DISPERSION * size / n * F.sqrt(2 * n * (n - 1) * equal * (1 - equal))
    chi_sd = F.sqrt(2 * (size - 1) * (n - 1) / n)
    runs_sd = DISPERSION * F.sqrt((n - 1) * F.greatest(text_rate, F.lit(0.02)) * (1 - text_rate))
    runs_random_sd = F.sqrt((n - 1) * F.greatest(random_rate * (1 - random_rate), F.lit(0.02)))
    serial_sd = DISPERSION / F.sqrt(n)
    tests = F.array(
        F.struct(((chi_text - chi) / chi_text_sd).alias("z"), ((chi_text - size + 1) / chi_text_sd).alias("d"), ((chi - size + 1) / chi_sd).alias("off")),
        F.struct(((changes - (n - 1) * text_rate) * F.signum(random_rate - text_rate) / runs_sd).alias("z"), ((n - 1) * F.abs(random_rate - text_rate) / runs_sd).alias("d"), (F.abs(changes - (n - 1) * random_rate) / runs_random_sd).alias("off")),
        F.struct(((text_serial - serial) / serial_sd).alias("z"), (text_serial / serial_sd).alias("d"), (F.abs(serial) * F.sqrt(n)).alias("off")),
    )

    def joined(t):
        total = lambda f: F.aggregate(t, F.lit(0.0), lambda a, x: a + f(x))
        power = total(lambda x: x["d"] * x["d"])
        fits = F.forall(t, lambda x: x["off"] <= FIT)
        return F.when(fits & (power > 0), _tail(total(lambda x: x["d"] * x["z"]) / F.sqrt(power))).otherwise(F.lit(1.0))

    return let(tests, joined)


def battery(token: Column) -> Column:
    """(encoding, band, bin) of a candidate (a bound value); bin is ten times the rounded-down negative logarithm of its
    p-value."""
    n = F.length(token).cast("double")
    sign = {c: chr(97 + k) for k, own in enumerate((UPPER, LOWER, DIGITS, "+/_=-")) for c in own}
    kinds = F.translate(token, "".join(sign), "".join(sign.values()))
    letters = F.translate(token, VOWELS + "".join(c for c in UPPER + LOWER if c not in VOWELS), "a" * 10 + "b" * 42)

    def changed(classes: Column) -> Column:
        return F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double") - 1

    def tested(chars: Column) -> Column:
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + let(n - F.length(F.replace(token, c, F.lit(""))), lambda o: o * o))
        codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))

        def correlated(v: Column) -> Column:
            mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n

            def around(d: Column) -> Column:
                spread = F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)
                joint = F.aggregate(F.zip_with(F.slice(d, F.lit(1), n.cast("int") - 1), F.slice(d, F.lit(2), n.cast("int") - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
                return F.when(spread > 0, joint / spread).otherwise(F.lit(1.0))

            return let(let(mean, lambda m: F.transform(v, lambda x: x - m)), around)

        def scored(code: Column) -> Column:
            classes = F.when(code == 2, letters).when((code == 4) | (code == 1), F.translate(kinds, "b", "a")).otherwise(kinds)
            p = let(codes, lambda v: let(correlated(v), lambda r: let(changed(classes), lambda x: p_value(n, code, squares, x, r))))
            band = sum((n >= b).cast("int") for b in LENGTH_BANDS)
            least = F.greatest(p, F.lit(10.0 ** (-BINS / 10)))
            return F.struct(code.alias("encoding"), band.alias("band"), F.floor(-10 * F.log10(least)).cast("int").alias("bin"))

        return let(encoding_of(token), scored)

    return let(F.split(token, ""), tested)


TEST = "struct<encoding:int,band:int,bin:int>"
PARTS = f"struct<start:int,end:int,test:{TEST}>"
RUNS = f"struct<start:int,end:int,test:{TEST},parts:array<{PARTS}>>"


def candidates(text: Column) -> Column:
    """Array of runs (start, end, test or null, parts): what the method tests of a text.

    The text is cut at assignments, so a run never reaches into one; a run directly before one belongs to its key.
    """
    based = lambda m: m.rlike(f"{ACCESS}|{HEX}")
    test = lambda m: F.when(~based(m), battery(m)).cast(TEST)

    def part(at):
        return lambda m, i: F.struct((at + i).alias("start"), (at + i + F.length(m)).alias("end"), test(m).alias("test"))

    def run(m, at):
        parts = F.when(m.rlike("[+/_=-]"), matches(m, PART, part(at), PARTS)).otherwise(F.array()).cast(f"array<{PARTS}>")
        return F.struct(at.alias("start"), (at + F.length(m)).alias("end"), test(m).alias("test"), parts.alias("parts"))

    def within(pieces: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: let(F.get(pieces, i), lambda q: F.filter(matches(q["piece"], RUN, lambda m, at: run(m, at + q["at"]), RUNS), lambda r: q["last"] | (r["end"] < q["end"])))))

    def cut(found: Column) -> Column:
        def placed(spans: Column) -> Column:
            begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
            piece = lambda b: lambda x, i: F.struct(x.alias("piece"), F.get(b, i).alias("at"), (F.get(b, i) + F.length(x)).alias("end"), (i == F.size(b) - 1).alias("last"))
            return let(begins, lambda b: F.transform(F.split(text, ASSIGN, -1), piece(b)))

        whole = F.array(F.struct(text.alias("piece"), F.lit(0).alias("at"), F.length(text).alias("end"), F.lit(True).alias("last")))
        return F.when(F.size(found) > 0, placed(found)).otherwise(whole)

    return let(let(spans_of(text, ASSIGN, 0), cut), within)


def thresholds(scanned: DataFrame, rate: float = 0.01) -> dict[tuple[int, int], int]:
    """Benjamini-Hochberg by stratum: the least bin that is a discovery.  The histogram has a fixed number of rows."""
    tests = F.flatten(F.transform("candidates", lambda r: F.concat(F.array(r["test"]), F.transform(r["parts"], lambda x: x["test"]))))
    rows = scanned.select(F.explode_outer(tests).alias("t")).where("t IS NOT NULL").groupBy("t.encoding", "t.band", "t.bin").count().collect()
    strata: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        strata.setdefault((r.encoding, r.band), {})[r.bin] = r["count"]
    out = {}
    for stratum, hist in strata.items():
        m, k = sum(hist.values()), 0
        for b in sorted(hist, reverse=True):
            k += hist[b]
            if 10 ** (-b / 10) * m / k <= rate:
                out[stratum] = b
    return out


def discovered(least: dict[tuple[int, int], int]) -> Column:
    """Base spans with the runs, or else the parts of runs, that are discoveries, sorted."""
    limits = F.create_map(F.lit(-1), F.lit(BINS + 1), *[F.lit(x) for (e, b), k in sorted(least.items()) for x in (100 * e + b, k)])
    limit = lambda t: F.coalesce(F.element_at(limits, 100 * t["encoding"] + t["band"]), F.lit(BINS + 1))
    good = lambda x: x["test"].isNotNull() & (x["test"]["bin"] >= limit(x["test"]))
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))
    found = F.flatten(F.transform("candidates", lambda r: F.when(good(r), F.array(span(r))).otherwise(F.transform(F.filter(r["parts"], good), span))))
    return F.array_sort(F.concat(F.col("base"), found))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, scratch: Scratch, keep_text: bool = False, rate: float = 0.01) -> DataFrame:
    """Adds ``base`` and ``spans`` (arrays of start, kind, end); the texts are read once, what is found is staged."""
    text = text_of()
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_text else [F.struct("doc_id").alias("row")]
    found = scratch.stage(docs.select(*kept, base_spans(text).alias("base"), candidates(text).alias("candidates")), "scanned")
    return found.select("row", "base", discovered(thresholds(found, rate)).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or each group of overlapping spans, replaced."""

    def replaced(chars: Column) -> Column:
        def joined(ends: Column) -> Column:
            piece = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
            parts = F.zip_with(spans, before(ends, largest=True), lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), piece(F.array_max(ends), F.size(chars)))

        return let(F.transform(spans, lambda s: s["end"]), joined)

    return F.when(F.size(spans) > 0, let(F.split(text, ""), replaced)).otherwise(text)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced; every row stays, and a null text stays null."""
    found = scan(docs, Scratch(docs.sparkSession, "secrets"), keep_text=True)
    clean = let(F.struct(F.col("row.text").alias("text"), F.col("spans").alias("spans")), lambda r: redacted(r["text"], r["spans"]))
    return found.select(*[(clean if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), Scratch(spark, "op2"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
