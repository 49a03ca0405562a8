"""A search index over sections that is written once and read by many questions, and a ranker for tables of questions.

Two tables, kept beside the sub-indexes of a build:

``records``   a row per section: normalised fields, number of tokens, vector.
``postings``  per token blocks of sections, best first: how often the token stands there, how many tokens the section has, in
              which fields it stands; with each block's largest count and smallest length, so blocks can be left out unread.

Fields hold a word where one of their tokens does, so the ranker's questions to fields are answered by the tokens that
contain a word.  Which these are comes from the tokens alone; then only their blocks are read, and of the records only the
sections found.  A section that shares no word with a question can score 0.26 at most, by its vector; the records are
passed over for it only where fewer than ``k`` sections score more.  Scores are those of ``search.score``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import query as Q
from leafloom.functions import text as T
from leafloom.operators import search as S

BLOCK = 128
#: Tokens and documents that are named in a filter of a scan; beyond it they are joined.
NAMED = 5000
#: Bytes of text whose tokens a task counts at once, entries that it sorts at once, blocks that it writes at once.
SLICE, SEGMENT, BLOCKS = 1 << 20, 1 << 21, 1 << 13
#: Words of questions that are compared with each token; more of them are joined to its pieces.
WORDS = 200
#: Questions that meet all records where these are read; more of them meet only the records found.
FEW = 16
#: Parts in which the best of a question's sections are found before they meet in one task.
PARTS = 64
FIELDS = list(S.FIELDS)
RECORDS = "doc_id string, section_id string, source string, title string, pos int, h_doc string, h_source string, h_title string, h_synopsis string, h_body string, length int, dim int, vector array<float>"
ENTRY = "struct<doc_id:string,section_id:string,tf:int,length:int,fields:int>"
POSTINGS = f"token string, most_tf int, least_length int, entries array<{ENTRY}>"
PARSED = "query_id string, question string, terms array<struct<k:int,term:string,weight:double,variants:array<string>>>, runs array<struct<text:string,weight:double>>, forms array<string>, locales array<string>, wants_history boolean"


def records(sections: DataFrame, vectors: DataFrame | None, summaries: DataFrame | None, sources: DataFrame | None, head: tuple[int, int] | None = None) -> DataFrame:
    """Rows of ``RECORDS`` and ``counted``: with ``head``, the words of a body that are counted where its field has others, else
    null, so fields are the tokens and no text is there twice.  ``sources``: doc_id, source; without it the sections have
    their source themselves (see ``search.records``)."""
    ord_ = F.lit(0).alias("doc_ord")
    rows = S.records(sections.select("*", ord_), vectors, summaries, None, head) if sources is None else S.records(sections, vectors, summaries, sources.select("*", ord_), head)
    more = F.when(F.length("body") > head[0], T.normalized(F.substring("body", 1, head[1]))) if head else F.lit(None)
    key = F.col("doc_id").cast("string").alias("doc_id")
    words = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "))) + 1)  # noqa: E731  fields have one space between words
    rows = rows.select(key, "section_id", "source", "title", F.col("rec_ord.pos").cast("int").alias("pos"), *FIELDS, more.cast("string").alias("counted"), F.size("vector").alias("dim"), F.transform("vector", lambda x: x.cast("float")).alias("vector"))
    length = sum((words(F.col(f)) for f in ("h_doc", "h_source", "h_title", "h_title", "h_synopsis")), words(F.coalesce("counted", "h_body")))
    return rows.withColumn("length", length.cast("int"))


def _segments(fields: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(POSTINGS))
    entry = arrow.field("entries").type

    def counted(batch, known: dict):
        """(record, code of the token, tf, fields) of some records: (record, token) as one number, sorted, and sums over its runs."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = [batch.column(4 + f).fill_null("") for f in range(fields)]
        lists = [pc.split_pattern(x, " ") for x in (*texts, texts[2], batch.column(3).fill_null(""))]  # FIELDS; a title counts twice
        bits = [*(1 << f for f in range(fields)), 0, 0]
        sizes = [len(pc.list_flatten(x)) for x in lists]
        words = pa.concat_arrays([pc.list_flatten(x).cast(pa.string()) for x in lists])
        of = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in lists]).astype(np.int64)
        counts, body = np.ones(len(of), np.int32), slice(sum(sizes[: fields - 1]), sum(sizes[:fields]))
        counts[body] = batch.column(3).is_null().to_numpy(zero_copy_only=False)[of[body]]  # else ``counted`` is what counts
        coded = words.dictionary_encode()
        place = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()] or [0], np.int64)
        codes, blank = place[coded.indices.to_numpy()], known.get("", -1)
        keep = np.flatnonzero(codes != blank)
        keys = of[keep] << 32 | codes[keep]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.flatnonzero(np.diff(keys, prepend=-1))
        if not len(begins):
            return None
        tf = np.add.reduceat(counts[keep][order], begins).astype(np.int32)
        where = np.bitwise_or.reduceat(np.repeat(bits, sizes)[keep][order], begins).astype(np.int32)
        return (keys[begins] >> 32).astype(np.int32), (keys[begins] & 0xFFFFFFFF).astype(np.int32), tf, where

    def packed(keys: list, parts: list, known: dict) -> Iterator:
        """Blocks of a segment, in order of their tokens."""
        import numpy as np
        import pyarrow as pa

        docs, sections, lengths = (pa.concat_arrays([k[c] for k in keys]) for c in range(3))
        of, code, tf, where = (np.concatenate([p[c] for p in parts]) for c in range(4))
        parts.clear()
        size = lengths.to_numpy()[of]
        names = sorted(known)
        rank = np.empty(len(known), np.int32)
        rank[[known[n] for n in names]] = np.arange(len(names))
        code = rank[code]
        order = np.lexsort((of, -(tf / (tf + S.K1 * (1 - S.B + S.B * size / 100))), code))
        of, code, tf, where, size = (x[order] for x in (of, code, tf, where, size))
        at = np.arange(len(code))
        new = np.diff(code, prepend=-1) != 0
        begins = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0)
        names = pa.array(names, pa.string())
        for k in range(0, len(begins), BLOCKS):  # some blocks at a time: strings of entries are made here
            own = begins[k : k + BLOCKS]
            end = int(begins[k + BLOCKS]) if k + BLOCKS < len(begins) else len(code)
            cut, take = slice(int(own[0]), end), pa.array(of[own[0] : end])
            columns = [docs.take(take), sections.take(take), pa.array(tf[cut]), pa.array(size[cut]), pa.array(where[cut])]
            entries = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, entry.value_type, strict=True)], fields=list(entry.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.append(own, end) - own[0], pa.int32()), entries, type=entry)
            most, least = np.maximum.reduceat(tf[cut], own - own[0]), np.minimum.reduceat(size[cut], own - own[0])
            rows = [names.take(pa.array(code[own])), pa.array(most), pa.array(least), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows, arrow, strict=True)], schema=arrow)

    def slices(batch) -> Iterator:
        """Runs of records with SLICE bytes of text or so, one record at least."""
        import numpy as np
        import pyarrow.compute as pc

        bytes_ = sum(pc.binary_length(batch.column(3 + f)).fill_null(0).to_numpy().astype(np.int64) for f in range(fields + 1))
        group = np.cumsum(bytes_) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)

    def run(batches: Iterator) -> Iterator:
        keys, parts, known, records, entries = [], [], {}, 0, 0
        for batch in batches:
            for part in slices(batch):
                found = counted(part, known)
                if found:
                    parts.append((found[0] + records, *found[1:]))
                    entries += len(found[0])
                keys.append([part.column(c) for c in range(3)])
                records += len(part)
                if entries >= SEGMENT:
                    yield from packed(keys, parts, known)
                    keys, parts, known, records, entries = [], [], {}, 0, 0
        if entries:
            yield from packed(keys, parts, known)

    return run


def postings(recs: DataFrame) -> DataFrame:
    """Blocks of ``POSTINGS``: each task sorts what it reads, SEGMENT entries at a time, so nothing is shuffled; a token has
    blocks of its own in each such part, and a scan passes by the pages of other tokens."""
    return recs.select("doc_id", "section_id", "length", "counted", *FIELDS).mapInArrow(_segments(len(FIELDS)), POSTINGS)


def _blocks():
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(POSTINGS))
    entry = arrow.field("entries").type

    def packed(rows, begins, end: int):
        """Rows up to ``end`` as the blocks that begin at the given places."""
        import numpy as np
        import pyarrow as pa

        column = lambda n: rows.column(rows.schema.get_field_index(n)).slice(0, end)
        entries = pa.StructArray.from_arrays([column(f.name).cast(f.type) for f in entry.value_type], fields=list(entry.value_type))
        most, least = np.maximum.reduceat(column("tf").to_numpy(), begins), np.minimum.reduceat(column("length").to_numpy(), begins)
        lists = pa.ListArray.from_arrays(pa.array([*begins, end], pa.int32()), entries, type=entry)
        columns = [column("token").take(pa.array(begins)), pa.array(most), pa.array(least), lists]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rest = None  # rows from the begin of the block that is open
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            token = rows.column(rows.schema.get_field_index("token"))
            new = np.ones(len(rows), bool)
            new[1:] = pc.not_equal(token.slice(1), token.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
            at = np.arange(len(rows))
            begins = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0)
            if begins[-1]:
                yield packed(rows, begins[:-1], int(begins[-1]))
            rest = rows.slice(int(begins[-1]))
        if rest is not None:
            yield packed(rest, np.zeros(1, np.int64), len(rest))

    return run


def _packed(flat: DataFrame) -> DataFrame:
    """Blocks of entries by ranges of (token, section), for a compaction: one part for a token, several for a very common one."""
    impact = F.col("tf") / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("length") / 100))
    ordered = flat.withColumn("impact", impact).repartitionByRange("token", "impact", "doc_id", "section_id").sortWithinPartitions("token", F.desc("impact"), "doc_id", "section_id")
    return ordered.drop("impact").mapInArrow(_blocks(), POSTINGS)


def write(commit, sections: DataFrame, vectors: DataFrame | None, summaries: DataFrame | None, sources: DataFrame | None, head: tuple[int, int] | None = None) -> None:
    """Adds the index of a commit's documents to it (see ``sources.store.Commit``); ``head`` see ``search.haystacks``.  Records
    stay in the tasks that made them, sorted there."""
    made = records(sections, vectors, summaries, sources, head).sortWithinPartitions("doc_id", "pos", "section_id")
    recs = commit.put("records", made, f"{RECORDS}, counted string", arranged=True)
    commit.put("postings", postings(recs), POSTINGS, arranged=True)


def compact(store, whole: bool = False) -> int:
    """Merges segments of the index (see ``Store.compact``)."""

    def remake(snapshot, rows: DataFrame) -> DataFrame:
        flat = rows.select("token", "seq", F.explode("entries").alias("e")).select("token", "e.*", "seq")
        return _packed(snapshot.without_replaced("postings", flat).drop("seq"))

    return store.compact("records", whole) + store.compact("postings", whole, remake)


@dataclass(frozen=True)
class Statistics:
    """Sections and their mean number of tokens."""

    n: int
    mean: float


_STATISTICS: dict[tuple, Statistics] = {}


class Index:
    """The index of one version of a store.  What is known of the whole is kept for the next question by the version's
    signature: another one begins anew."""

    def __init__(self, snapshot):
        self.snapshot, self.spark = snapshot, snapshot.store.spark
        self.records = snapshot.read("records", RECORDS)
        self.work: list[str] = []
        self.signature = (snapshot.store.root, *snapshot.signature("records", "postings"))

    def kept(self, rows: DataFrame) -> DataFrame:
        """The rows as a table below the store, where an answer needs them more than once; ``clean`` takes it away."""
        self.work.append(f"{self.snapshot.store.root}/_work/{uuid.uuid4().hex[:12]}")
        rows.write.parquet(self.work[-1])
        return self.spark.read.schema(rows.schema).parquet(self.work[-1])

    def clean(self) -> None:
        """Deletes what answers were made from; they can't be read again after it."""
        while self.work:
            self.snapshot.store.delete(self.work.pop())

    def statistics(self) -> Statistics:
        if self.signature not in _STATISTICS:
            row = self.records.agg(F.count(F.lit(1)), F.avg("length")).first()
            while len(_STATISTICS) >= 4:
                del _STATISTICS[next(iter(_STATISTICS))]
            _STATISTICS[self.signature] = Statistics(row[0], row[1] or 0.0)
        return _STATISTICS[self.signature]

    def blocks(self, tokens: list[str] | DataFrame | None = None) -> DataFrame:
        """Blocks of tokens: a list is a filter of the scan, which passes by the files and pages of others."""
        content = self.snapshot.content["tables"]["postings"]
        rows = self.spark.read.schema(f"{POSTINGS}, seq long").parquet(*[f"{self.snapshot.store.root}/{s['path']}" for s in content])
        if isinstance(tokens, list):
            return rows.where(F.col("token").isin(*tokens))
        return rows if tokens is None else rows.join(tokens.select("token"), "token", "left_semi")

    def entries(self, blocks: DataFrame, *more: str) -> DataFrame:
        """``token, doc_id, section_id, tf, length, fields`` (and ``more`` columns) of blocks, without documents that later
        versions replaced."""
        rows = blocks.select("token", *more, "seq", F.explode("entries").alias("e")).select("token", *more, "e.*", "seq")
        return self.snapshot.without_replaced("postings", rows).drop("seq")

    def tokens(self) -> DataFrame:
        return self.blocks().select("token").distinct()


# --- questions ---


def _parse(locales: tuple[str, ...]):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(PARSED))

    def row(key: str, question: str) -> dict:
        q = Q.parse(question or "", locales)
        n = len(q.terms)
        runs = [(" ".join(q.terms[k : k + s]), float(s)) for s in range(min(4, n), 1, -1) for k in range(n - s + 1)]
        runs += [(p, Q.phrase_weight(p)) for p in q.phrases]
        terms = [{"k": k, "term": t, "weight": q.weights[t], "variants": q.variants[t]} for k, t in enumerate(q.terms)]
        return {"query_id": key, "question": question, "terms": terms, "runs": [{"text": t, "weight": w} for t, w in runs], "forms": q.variants[q.terms[0]] if q.terms else [], "locales": q.locales, "wants_history": q.wants_history}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pylist([row(k, q) for k, q in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True)], schema=arrow)

    return run


def parsed(questions: DataFrame, locales: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, question`` (and more columns) as rows of ``PARSED``."""
    rest = [c for c in questions.columns if c not in ("query_id", "question")]
    own = questions.select(F.col("query_id").cast("string").alias("query_id"), "question").mapInArrow(_parse(locales), PARSED)
    return own.join(questions.select(F.col("query_id").cast("string").alias("query_id"), *rest), "query_id") if rest else own


def matches(tokens: DataFrame, asked: DataFrame, lengths: list[int]) -> DataFrame:
    """``variant, token`` where the token contains the variant, as an equi join on the token's pieces of the lengths that
    occur."""
    words = asked.select(F.explode("terms.variants").alias("v")).select(F.explode("v").alias("variant")).distinct()
    extra = asked.select(F.explode("runs.text").alias("r")).select(F.explode(F.split("r", " ")).alias("variant"))  # a run stands where its words do
    words = words.union(extra).distinct()
    pieces = F.flatten(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length("token") >= n, F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda k: F.substring("token", k, n))).otherwise(F.array())))
    return tokens.select("token", F.explode(F.array_distinct(pieces)).alias("variant")).join(words, "variant").select("variant", "token")


def hits(index: Index, asked: DataFrame) -> DataFrame:
    """``variant, token, doc_id, section_id, tf, length, fields``: entries of the tokens that contain a word of a question."""
    words = F.concat(F.flatten("terms.variants"), F.flatten(F.transform("runs", lambda r: F.split(r["text"], " "))))
    words = sorted(r.w for r in asked.select(F.explode(words).alias("w")).where("w <> ''").distinct().limit(WORDS + 1).collect())
    if len(words) <= WORDS:  # compared where blocks are read: no join
        held = F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(F.col("token"), w))
        having = lambda blocks: blocks.withColumn("variants", held).where(F.size("variants") > 0)
        few = [r.token for r in having(index.blocks().select("token")).select("token").distinct().limit(NAMED + 1).collect()]
        entries = index.entries(having(index.blocks(few if len(few) <= NAMED else None)), "variants")
        return entries.withColumn("variant", F.explode("variants")).drop("variants")
    sizes = F.transform(F.flatten("terms.variants"), lambda v: F.length(v))
    runs = F.flatten(F.transform("runs", lambda r: F.transform(F.split(r["text"], " "), lambda w: F.length(w))))
    lengths = sorted(r.n for r in asked.select(F.explode(F.concat(sizes, runs)).alias("n")).where("n > 0").distinct().limit(64).collect())  # lengths of words
    if not lengths:
        lengths = [1]
    pairs = index.kept(matches(index.tokens(), asked, lengths))
    few = [r.token for r in pairs.select("token").distinct().limit(NAMED + 1).collect()]
    blocks = index.blocks(few if len(few) <= NAMED else pairs.select("token").distinct())
    entries = index.entries(blocks)
    return entries.join(pairs, "token")


def _weights(n: int) -> tuple:
    top = F.log(F.lit(1 + (n + 0.5) / 0.5))

    def rare(c: Column) -> Column:
        return F.when(c == 0, 1.0).otherwise(0.35 + 0.65 * T.clamp(F.log(1 + (n - c + 0.5) / (c + 0.5)) / top))

    def idf(d: Column) -> Column:
        return F.log(1 + (max(1, n) - d + 0.5) / (d + 0.5))

    return rare, idf


def score(index: Index, questions: DataFrame, k: int = 8, locales: tuple[str, ...] = ()) -> DataFrame:
    """Signals and ``base_score`` of all sections that a question can find among its ``k`` best, for every row of ``query_id,
    question`` (and ``vector``, a unit vector) in one plan."""
    stats = index.statistics()
    with_vectors = "vector" in questions.columns
    asked = parsed(questions.withColumnRenamed("vector", "asked") if with_vectors else questions, locales)
    if not with_vectors:
        asked = asked.withColumn("asked", F.lit(None).cast("array<double>"))
    asked = index.kept(asked)
    words = hits(index, asked)
    variants = asked.select("query_id", F.posexplode("terms").alias("at", "t")).select("query_id", "t.k", F.explode("t.variants").alias("variant"))
    variants = variants.unionByName(asked.select("query_id", F.lit(-1).alias("k"), F.explode(F.flatten(F.transform("runs", lambda r: F.split(r["text"], " ")))).alias("variant")).distinct())
    tf = F.when(F.col("token") == F.col("variant"), F.col("tf")).otherwise(0)
    by_term = words.join(variants, "variant").groupBy("query_id", "doc_id", "section_id", "length", "k").agg(F.bit_or("fields").alias("fields"), F.max(tf).alias("tf"))
    by_term = index.kept(by_term)

    # statistics of each question's terms: sections with the commonest variant, and with any
    exact = words.where("token = variant AND tf > 0")
    df = exact.groupBy("variant").agg(F.count(F.lit(1)).alias("df"))
    df = variants.where("k >= 0").join(df, "variant").groupBy("query_id", "k").agg(F.max("df").alias("df"))
    cover = by_term.where("tf > 0 AND k >= 0").groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("cover"))
    rare, idf = _weights(stats.n)
    terms = asked.select("query_id", F.explode("terms").alias("t")).select("query_id", "t.k", "t.term", "t.weight")
    terms = terms.join(df, ["query_id", "k"], "left").join(cover, ["query_id", "k"], "left").na.fill(0, ["df", "cover"])
    terms = terms.withColumn("w", F.col("weight") * rare(F.col("cover")))
    terms = terms.withColumn("idf", F.when(F.col("df") > 0, idf(F.col("df")) * F.col("w")).otherwise(0.0))
    per = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "term", "w", "idf"))).alias("ts"))  # forty terms or so
    asked_in_full = asked.join(per, "query_id", "left").drop("terms").withColumn("ts", F.coalesce("ts", F.array().cast("array<struct<k:int,term:string,w:double,idf:double>>")))

    found = by_term.groupBy("query_id", "doc_id", "section_id").agg(F.collect_list(F.struct("k", "fields", "tf")).alias("found"))
    keys = found.select("doc_id").distinct().limit(NAMED + 1).collect()
    recs = index.records if len(keys) > NAMED else index.records.where(F.col("doc_id").isin(*[r.doc_id for r in keys]))
    few = asked.select("query_id", "asked", "runs").limit(FEW + 1).collect()
    if len(few) <= FEW:
        recs = _met(index, recs, few, asked.select("query_id", "asked", "runs").schema.simpleString())
        of = lambda name: F.get(F.filter("met", lambda m: m["query_id"] == F.col("query_id")), F.lit(0))[name]
        rows = found.join(recs, ["doc_id", "section_id"]).withColumns({"dense": of("dense"), "in_runs": of("in_runs")}).drop("met")
        rows = rows.withColumns({"h_doc": T.normalized(F.col("doc_id")), "h_source": T.normalized(F.col("source")), "h_title": T.normalized(F.col("title"))}).join(asked_in_full, "query_id")
    else:
        rows = found.join(recs, ["doc_id", "section_id"]).join(asked_in_full, "query_id").withColumn("in_runs", _in_runs(F.col("runs"))).withColumn("dense", _dense())
    if with_vectors:
        rows = rows.where("asked IS NULL OR dim = size(asked)")
    scored = index.kept(_scored(rows, stats))
    return _with_dense(index, asked_in_full, scored, stats, k, with_vectors)


def _in_runs(runs: Column) -> Column:
    """The weights of the runs that stand in a record's fields, which are normalised already."""
    whole = F.array_join(F.filter(F.array(*FIELDS), lambda x: x != ""), " ")
    return T.let(whole, lambda w: F.aggregate(F.filter(runs, lambda r: F.contains(w, r["text"])), F.lit(0.0), lambda a, r: a + r["weight"]))


def _met(index: Index, recs: DataFrame, few: list, ddl: str) -> DataFrame:
    """Records with what needs their texts and vectors, for each of FEW questions, in place of these: a join moves neither."""
    block = F.broadcast(index.spark.createDataFrame([(few,)], f"block array<{ddl}>"))  # FEW questions at most
    one = lambda q: F.struct(q["query_id"].alias("query_id"), F.coalesce(T.clamp(T.dot(F.col("vector"), q["asked"])), F.lit(0.0)).alias("dense"), _in_runs(q["runs"]).alias("in_runs"))
    return recs.join(block).select("doc_id", "section_id", "source", "title", "pos", "length", "dim", F.transform("block", one).alias("met"))


def _scored(rows: DataFrame, stats: Statistics) -> DataFrame:
    none = F.struct(F.lit(0).alias("fields"), F.lit(0).alias("tf"))
    by_k = F.map_from_entries(F.transform("found", lambda f: F.struct(f["k"], F.struct(f["fields"].alias("fields"), f["tf"].alias("tf")))))
    rows = rows.withColumn("m", by_k).withColumn("ts", F.transform("ts", lambda t: F.struct(t["term"].alias("term"), t["w"].alias("w"), t["idf"].alias("idf"), F.coalesce(F.element_at("m", t["k"]), none).alias("f")))).drop("m", "found")
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))
    has = lambda t, mask: t["f"]["fields"].bitwiseAND(F.lit(mask)) > 0
    bit = {name: 1 << k for k, name in enumerate(FIELDS)}
    head = bit["h_doc"] | bit["h_source"] | bit["h_title"]
    ts, weight = F.col("ts"), total(F.col("ts"), lambda t: t["w"])
    kept = lambda n: F.slice(F.filter("ts", lambda t: t["w"] > 0), 1, n)
    part = lambda n, f: total(kept(n), f) / total(kept(n), lambda t: t["w"])

    in_fields = total(ts, lambda t: t["w"] * S.add([F.when(has(t, bit[f]), w).otherwise(0.0) for f, w in S.FIELDS.items()]))
    profile = F.when(weight > 0, F.least(F.lit(1.0), (in_fields + F.col("in_runs")) / (weight * sum(S.FIELDS.values())))).otherwise(0.0)
    focus = F.when(weight > 0, T.clamp(part(2, lambda t: t["w"] * F.when(has(t, head), 1.0).when(has(t, bit["h_synopsis"]), S.FOCUS_SYNOPSIS).when(has(t, bit["h_body"]), S.FOCUS_BODY).otherwise(0.0)))).otherwise(1.0)
    coverage = F.when(weight > 0, T.clamp(total(F.filter("ts", lambda t: t["f"]["fields"] > 0), lambda t: t["w"]) / weight)).otherwise(1.0)
    identity = F.when(weight > 0, S.IDENTITY * T.clamp(part(3, lambda t: F.when(has(t, bit["h_doc"] | bit["h_source"]), t["w"]).otherwise(0.0)))).otherwise(0.0)
    best = F.greatest(F.when(F.array_contains("forms", F.col("h_doc")) | F.array_contains(F.transform("forms", lambda v: F.concat(F.lit("docs "), v)), F.col("h_doc")), S.OVERVIEW_DOC).otherwise(0.0), F.when(F.array_contains("forms", F.col("h_title")), S.OVERVIEW_TITLE).otherwise(0.0))
    overview = F.least(F.lit(S.OVERVIEW_MOST), best + F.when((best > 0) & (T.occurrences(F.col("section_id"), F.lit("/")) <= 1), S.OVERVIEW_SHALLOW).otherwise(0.0))
    length = S.K1 * ((1 - S.B) + S.B * F.col("length") / (stats.mean or 1.0))
    counted = F.filter("ts", lambda t: (t["f"]["tf"] > 0) & (t["idf"] > 0))
    most = total(counted, lambda t: t["idf"] * (S.K1 + 1))
    sparse = F.when(most > 0, T.clamp(total(counted, lambda t: t["idf"] * t["f"]["tf"] * (S.K1 + 1) / (t["f"]["tf"] + length)) / most)).otherwise(0.0)
    supported = F.when(F.size("ts") == 0, True).otherwise(has(F.get("ts", F.lit(0)), head))
    rows = rows.select("*", F.col("dense").alias("vector_score"), profile.alias("profile"), focus.alias("focus"), coverage.alias("coverage"), overview.alias("overview"), sparse.alias("sparse_score"), identity.alias("identity_bonus"), _factor(supported).alias("rank_factor"))
    raised = F.when((F.col("profile") <= 0) | (F.col("focus") >= 1), F.col("profile")).otherwise(F.col("profile") * (S.FOCUS_FLOOR + S.FOCUS_WEIGHT * F.col("focus")))
    rows = rows.withColumn("lexical_score", F.least(F.lit(1.0), raised * (S.COVERAGE_FLOOR + S.COVERAGE_WEIGHT * F.col("coverage")) + F.col("overview")))
    base = F.least(F.lit(1.0), S.blend(F.col("vector_score"), F.col("lexical_score"), F.col("sparse_score")) + F.col("identity_bonus")) * F.col("rank_factor")
    terms = F.transform(F.filter("ts", lambda t: t["f"]["fields"] > 0), lambda t: t["term"])
    return rows.withColumn("base_score", base).withColumn("matched_terms", terms).select(*OUT)


OUT = ["query_id", "doc_id", "section_id", "source", "title", "pos", "vector_score", "lexical_score", "sparse_score", "identity_bonus", "rank_factor", "base_score", "matched_terms"]


def _dense() -> Column:
    return F.coalesce(T.clamp(T.dot(F.col("vector"), F.col("asked"))), F.lit(0.0))


def _factor(supported: Column) -> Column:
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.[^./]+)?$", 1)
    loose = ~F.contains(F.col("source"), F.lit("/")) & ~stem.isin("README", "CHANGELOG") & (stem == F.upper(stem))
    old = F.arrays_overlap(F.split(F.concat_ws(" ", "h_doc", "h_source", "h_title"), " "), F.array(*[F.lit(x) for x in Q.HISTORY_DOCS]))
    locale = T.source_locale(F.col("source"), Q.LOCALES)
    out = F.when(loose & ~supported, S.ROOT_META).otherwise(1.0) * F.when(~F.col("wants_history") & old, S.HISTORY).otherwise(1.0)
    return out * F.when((F.size("locales") == 0) | locale.isNull(), 1.0).when(F.array_contains("locales", locale), S.LOCALE_MATCH).otherwise(S.LOCALE_MISMATCH)


def _with_dense(index: Index, asked: DataFrame, scored: DataFrame, stats: Statistics, k: int, with_vectors: bool) -> DataFrame:
    """Adds, for questions that find fewer than ``k`` sections above what a vector alone can give, the best of the rest of
    the records."""
    most = S.VECTOR_ONLY * S.LOCALE_MATCH
    full = scored.where(F.col("base_score") >= most).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= k).select("query_id")
    thin = asked.join(full, "query_id", "left_anti").select("query_id", "asked", "locales", "wants_history", (F.size("ts") == 0).alias("no_terms"))
    one = thin.limit(NAMED + 1).collect()
    if not one:
        return scored
    if len(one) > NAMED:
        raise schema.InvalidInput(f"more than {NAMED} questions find too little; ask them in parts")
    block = F.broadcast(index.spark.createDataFrame([(one,)], f"block array<{thin.schema.simpleString()}>"))  # NAMED questions at most
    rest = index.records.join(block).select("*", F.explode("block").alias("q")).select("doc_id", "section_id", "source", "title", "pos", *FIELDS, "dim", "vector", "q.*")
    if with_vectors:
        rest = rest.where("asked IS NULL OR dim = size(asked)")
    rest = rest.select("query_id", "doc_id", "section_id", "source", "title", "pos", _dense().alias("vector_score"), F.lit(0.0).alias("lexical_score"), F.lit(0.0).alias("sparse_score"), F.lit(0.0).alias("identity_bonus"), _factor(F.col("no_terms")).alias("rank_factor"))
    rest = rest.withColumn("base_score", S.VECTOR_ONLY * F.col("vector_score") * F.col("rank_factor")).withColumn("matched_terms", F.array().cast("array<string>"))
    rest = rest.join(scored.select("query_id", "doc_id", "section_id"), ["query_id", "doc_id", "section_id"], "left_anti").select(*OUT)
    by = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("base_score"), "pos")
    best = Window.partitionBy("query_id").orderBy(F.desc("base_score"), "source", "doc_id", "pos")
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("doc_id", "section_id"), F.lit(PARTS))).orderBy(F.desc("base_score"), "source", "doc_id", "pos")
    top = rest.withColumn("own", F.row_number().over(by)).where(F.col("own") <= k)
    for order in (part, best):  # the best of each part, then of these, so no task has all sections of a question
        top = top.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k * k)
    return scored.unionByName(top.select(*OUT))


def propagate(index: Index, scored: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``score`` with the mean of the neighbours' base scores by weight; neighbours that weren't found count as 0."""
    ends = scored.select("query_id", F.col("doc_id").alias("n_doc"), F.col("section_id").alias("n_section"), F.col("base_score").alias("near"))
    around = scored.select("query_id", "doc_id", "section_id").join(edges, ["doc_id", "section_id"]).join(ends, ["query_id", "n_doc", "n_section"], "left")
    graph = around.groupBy("query_id", "doc_id", "section_id").agg((F.sum(F.coalesce("near", F.lit(0.0)) * F.col("weight")) / F.sum("weight")).alias("graph_score"))
    rows = scored.join(graph, ["query_id", "doc_id", "section_id"], "left")
    final = F.least(F.lit(1.0), S.blend(F.col("vector_score"), F.col("lexical_score"), F.col("sparse_score"), F.col("graph_score")) + F.col("identity_bonus")) * F.col("rank_factor")
    return rows.withColumn("score", final)


def search(index: Index, questions: DataFrame, k: int = 8, sections_per_doc: int = 1, locales: tuple[str, ...] = (), edges: DataFrame | None = None) -> DataFrame:
    """The ``k`` best sections of each question with ``rank``: the best of each document first, then up to
    ``sections_per_doc`` of each."""
    schema.within("sections_per_doc", sections_per_doc, 1, 8)
    rows = score(index, questions, k, locales)
    rows = propagate(index, rows, edges) if edges is not None else rows.withColumn("score", F.col("base_score"))
    by = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "pos")
    rows = rows.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= sections_per_doc)
    order = Window.partitionBy("query_id").orderBy(F.col("rn") > 1, F.desc("score"), "source", "doc_id", "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rn")


def bm25(index: Index, question: str, k: int = 50, ties: bool = False) -> DataFrame:
    """The ``k`` best sections by the sparse signal, by reading few blocks: a section's score is a weighted mean over its
    terms and so at most the largest of them, which a block's largest count and smallest length bound.  The ``k``-th best of
    the first blocks' sections is a score to reach; blocks that can't are left out.  With ``ties``, also what equals the last."""
    stats, q = index.statistics(), Q.parse(question)
    forms = {t: [v for v in q.variants[t] if " " not in v] for t in q.terms}
    named = sorted({v for vs in forms.values() for v in vs})
    schema.within("words", len(named), 1, NAMED)
    blocks = index.blocks(named)
    length = lambda c: S.K1 * ((1 - S.B) + S.B * F.col(c) / (stats.mean or 1.0))
    bound = F.col("most_tf") / (F.col("most_tf") + length("least_length"))
    first = blocks.select("token", bound.alias("bound"), F.size("entries").alias("n")).where("bound > 0")
    best = first.orderBy(F.desc("bound")).limit(4 * (1 + k // BLOCK)).agg(F.min("bound")).first()[0]
    counts = index.entries(blocks).where("tf > 0")
    of = index.spark.createDataFrame([(k_, v, q.weights[t]) for k_, t in enumerate(q.terms) for v in forms[t]], "k int, token string, weight double")
    of = F.broadcast(of)  # a question's words
    df = counts.join(of, "token").groupBy("k", "token", "weight").agg(F.count(F.lit(1)).alias("n"))
    held = counts.join(of, "token").groupBy("k").agg(F.countDistinct("doc_id", "section_id").alias("cover"))
    rare, idf = _weights(stats.n)
    terms = df.groupBy("k", "weight").agg(F.max("n").alias("df")).join(held, "k")
    terms = {r.k: r.w for r in terms.select("k", (idf(F.col("df")) * F.col("weight") * rare(F.col("cover"))).alias("w")).collect()}
    weights = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair]) if terms else F.lit(None).cast("map<int,double>")

    def scores(among: DataFrame) -> DataFrame:
        rows = counts.join(among, ["doc_id", "section_id"], "left_semi").join(of, "token").groupBy("doc_id", "section_id", "length", "k").agg(F.max("tf").alias("tf"))
        w = F.element_at(weights, F.col("k"))
        return rows.groupBy("doc_id", "section_id").agg((F.sum(w * F.col("tf") / (F.col("tf") + length("length"))) / F.sum(w)).alias("sparse"))

    sections = lambda b: index.entries(b).where("tf > 0").select("doc_id", "section_id").distinct()
    if best is None:
        return index.spark.createDataFrame([], "doc_id string, section_id string, sparse double")
    reach = scores(sections(blocks.where(bound >= best))).orderBy(F.desc("sparse")).limit(k).agg(F.min("sparse"), F.count(F.lit(1))).first()
    least = reach[0] - 1e-6 if reach[1] >= k else 0.0
    found = scores(sections(blocks.where(bound >= least)))
    if ties:
        last = found.select(F.round("sparse", 6).alias("s")).orderBy(F.desc("s")).limit(k).agg(F.min("s")).first()[0]
        return found.where(F.round("sparse", 6) >= F.lit(last))
    return found.orderBy(F.desc("sparse"), "doc_id", "section_id").limit(k)
