"""Operator 13: which terms set a source apart from its language, and how far sources are from each other.

A byte-level tokenizer works on the UTF-8 buffers of a batch as they are: one lookup table gives each byte its class and
its lower case, class changes and text borders are the boundaries of terms, slices are grouped by xxhash and every slice
is compared with its group's first one byte by byte.  Counts of (lang, source, term) are summed by Spark.  The kept terms
of a lang are dealt to buckets; a bucket is a sparse matrix (rows: sources, columns: terms) whose divergences are sums
over its stored entries by ``reduceat``, with what absent entries add counted by how many there are.  Sums of buckets are
added, so no task holds a lang.

All arithmetic is exact in 64-bit integers, up to 9e15 terms of a lang.

Defined results: null text, lang and source count as ''; repeated rows and rows with a null doc_id count as documents; a
source without terms has all its pairs; a lang without kept terms has pairs of value 0 and no terms; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, arrow_schema, documents, small_batches

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Rows (a term's count in a source) of a bucket, and counts that a task holds before it hands them on.
BUCKET_ROWS, HELD = 400_000, 1_000_000
COUNTS = "lang string, source string, term binary, n long, docs long"
PARTS = "lang string, source string, part string, item binary, value long"


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to a term, and its lower case: letters and all bytes outside ASCII do."""
    table = np.arange(256)
    upper = (table >= 65) & (table <= 90)
    return upper | ((table >= 97) & (table <= 122)) | (table >= 128), np.where(upper, table + 32, table).astype(np.uint8)


_IN_TERM, _LOWER = byte_tables()


def terms_of(raw: np.ndarray, edges: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and text, start and end of each term, of texts that lie one after another in ``raw``."""
    text = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_TERM[raw]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = edges[(edges > 0) & (edges < len(raw))]
    starts[edge] |= inside[1:-1][edge]
    ends[edge - 1] |= inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return text.tobytes(), np.searchsorted(edges, starts, "right") - 1, starts, ends


def group_slices(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each slice and each group's first slice: equal hashes, and equal bytes."""
    from xxhash import xxh3_64_intdigest

    hashes = np.fromiter((xxh3_64_intdigest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    model = first[group]
    same = sizes == sizes[model]
    raw = np.frombuffer(text, np.uint8)
    width = np.where(same, sizes, 0)
    within = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    unequal = raw[np.repeat(starts, width) + within] != raw[np.repeat(starts[model], width) + within]
    if unequal.any():
        same[np.repeat(np.arange(len(starts)), width)[unequal]] = False
    if not same.all():  # slices whose hash another term has: a group for each by its bytes
        own: dict[bytes, int] = {}
        extra = []
        for k in np.flatnonzero(~same).tolist():
            piece = text[starts[k] : ends[k]]
            if piece not in own:
                own[piece] = len(first) + len(own)
                extra.append(k)
            group[k] = own[piece]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return group, first


class Counter:
    """Counts of terms by group of documents, and in how many documents each is, over the batches of a task."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.sums = [], []
        self.held = 0

    def add(self, groups: list[tuple[str, str]], raw: np.ndarray, edges: np.ndarray) -> None:
        text, doc, starts, ends = terms_of(raw, edges)
        if not len(starts):
            return
        term, first = group_slices(text, starts, ends)
        which = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        number = np.array([self.terms.setdefault(text[a:b], len(self.terms)) for a, b in zip(starts[first].tolist(), ends[first].tolist())], np.int64)
        pair, n = np.unique(doc * len(first) + term, return_counts=True)  # a term in a document
        key, at = np.unique((which[pair // len(first)] << 40) | number[pair % len(first)], return_inverse=True)
        self.keys.append(key)
        self.sums.append(np.stack([np.bincount(at, n, len(key)), np.bincount(at, minlength=len(key))]).astype(np.int64))
        self.held += len(key)
        if self.held > 4 * HELD:
            self.fold()

    def fold(self) -> None:
        if self.keys:
            key, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            order = np.argsort(at, kind="stable")
            sums = np.add.reduceat(np.concatenate(self.sums, axis=1)[:, order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=1)
            self.keys, self.sums, self.held = [key], [sums], len(key)

    def rows(self, schema) -> Iterator:
        import pyarrow as pa

        self.fold()
        if not self.keys:
            return
        terms, groups = pa.array(list(self.terms), pa.binary()), list(self.groups)
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in range(2))
        key, (n, docs) = self.keys[0], self.sums[0]
        for a in range(0, len(key), 50_000):
            k = key[a : a + 50_000]
            g = pa.array(k >> 40)
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms.take(pa.array(k & (1 << 40) - 1)), pa.array(n[a : a + 50_000]), pa.array(docs[a : a + 50_000])], schema=schema)
        self.__init__()


def _counted():
    schema = arrow_schema(COUNTS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter()
        for batch in batches:
            langs, sources = (batch.column(k).to_pylist() for k in range(2))
            column = batch.column(2).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            data = column.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            begin = 0
            while begin < len(column):  # texts of about 500,000 bytes at once; a longer text is alone
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + 500_000, "right")) - 1)
                counter.add(list(zip(langs[begin:end], sources[begin:end])), raw[at[begin] : at[end]], at[begin : end + 1] - at[begin])
                begin = end
                if counter.held > HELD:
                    counter.fold()
                    if counter.held > HELD // 2 or len(counter.terms) > HELD:
                        yield from counter.rows(schema)
        yield from counter.rows(schema)

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), one row per term of a source."""
    small_batches(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(_counted(), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * size)), exact: the quotient is made three digits at a time."""
    below = np.asarray(total, np.int64) + 2 * size
    above = np.asarray(count, np.int64) + 2
    out, rest = np.divmod(above, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def bucket_parts(totals: np.ndarray, lang_total: int, size: int, terms: list[bytes], row: np.ndarray, column: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """What one bucket of terms adds: (source, part, items, values), each pair of sources once and the best terms of each.

    The entries are those of a sparse matrix in row order; ``totals``: N of each source; an item is a source or a column.
    """
    k, width = len(totals), len(terms)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    have = row[starts]  # rows with entries
    span = dict(zip(have.tolist(), zip(starts.tolist(), np.append(starts[1:], len(row)).tolist())))
    p = shares(count, totals[row], size)
    none = shares(np.zeros(k), totals, size)
    whole = np.zeros(width, np.int64)
    np.add.at(whole, column, count)
    q = shares(whole, lang_total, size)[column]
    value = divergence(p, q)
    for r, (a, b) in span.items():
        up = sorted((a + np.flatnonzero(p[a:b] > q[a:b])).tolist(), key=lambda e: (-value[e], terms[column[e]]))[:TOP]
        yield r, "term", column[up], value[up]
    for r in range(k - 1):
        dense = np.full(width, none[r])
        a, b = span.get(r, (0, 0))
        dense[column[a:b]] = p[a:b]
        sums = np.zeros(k, np.int64)  # where the other has an entry: by its own share instead of that of none
        if len(have):
            sums[have] = np.add.reduceat(divergence(p, dense[column]) - divergence(none[row], dense[column]), starts)
        level, times = np.unique(dense, return_counts=True)  # where it has none: few distinct shares, many terms
        for begin in range(r + 1, k, 1024):
            sums[begin : begin + 1024] += divergence(none[begin : begin + 1024, None], level[None, :]) @ times
        yield r, "pair", np.arange(r + 1, k), sums[r + 1 :]


def _bucket():
    schema = arrow_schema(PARTS)

    def run(entries, groups):
        """The parts of one bucket of a lang; ``groups``: all sources of the lang with their totals."""
        import pyarrow as pa

        groups = groups.sort_by("source")
        sources, totals = groups["source"].combine_chunks(), groups["total"].to_numpy()
        lang_total, size = groups["lang_total"][0].as_py(), groups["size"][0].as_py()
        if not len(entries) and size:
            return schema.empty_table()
        row = np.searchsorted(np.array(sources.to_pylist(), object), np.array(entries["source"].to_pylist(), object)).astype(np.int64)
        order = np.argsort(row, kind="stable")
        code = entries["term"].combine_chunks().dictionary_encode()
        terms = code.dictionary
        found = bucket_parts(totals, lang_total, size, terms.to_pylist(), row[order], code.indices.to_numpy().astype(np.int64)[order], entries["n"].to_numpy()[order])
        tables = []
        for r, part, items, values in found:
            named = terms.take(pa.array(items)) if part == "term" else sources.take(pa.array(items)).cast(pa.binary())
            columns = [pa.repeat(groups["lang"][0], len(items)), pa.repeat(sources[r], len(items)), pa.repeat(pa.scalar(part), len(items)), named, pa.array(values)]
            tables.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: divergence of each source to the others of its lang, and its own terms.

    Pairs are as many as the sources of a lang squared: they are the result.  A bucket holds about 400,000 counts; the number
    of buckets is that of all kept counts over this, the same for each lang.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    counts = scratch.stage(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least_docs).select("lang", "term")
    entries = scratch.stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "entries")
    scratch.drop("counts")
    buckets = max(1, -(-entries.count() // BUCKET_ROWS))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = entries.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("size"))
    groups = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "size"])
    groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    parts = dealt.groupBy("lang", "bucket").cogroup(groups.groupBy("lang", "bucket")).applyInArrow(_bucket(), PARTS)
    parts = scratch.stage(parts.withColumn("item", F.col("item").cast("string")), "parts")
    scratch.drop("entries")
    one = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = one.select("lang", ways.alias("w"), "part", "value").select("lang", "w.source", "part", "w.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))
