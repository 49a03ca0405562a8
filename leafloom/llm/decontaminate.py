"""Operator 3: benchmark decontamination by template windows, in SQL functions only.

Numbers, units after numbers and names (capitalised words, wherever they stand) become typed placeholders, so a question
with other values has the same template.  Windows of the plain words in lower case are compared too, so a copy is found in
any case and wrapping.

1. Windows of five words of all documents are hash-joined with the distinct windows of the benchmark: the hits.
2. The hits give each window's frequency.  A document that holds 80 % of an item's distinct windows holds one of its
   rarest 20 % (and one more), so only those name candidate pairs; a window that all documents share pairs nothing.
3. A pair's coverage is counted from all hits.  Pairs of 80 % are compared slot by slot: an item's value must stand for one
   value of the document, and two names for two names (numbers and units may coincide), in 80 % of the slots; for each
   shift between the two texts that many windows agree on, the best counts.  Where all values are equal it is a copy.
4. An item of two to four words is found as one window of its own length, at any place; an item of one word only where
   a whole line consists of it.

Defined results: null and empty texts hold nothing; rows that share a doc_id are one document; rows without doc_id or
item_id match nothing, nor does a null or empty item; items that share an item_id are looked for each, the best counts; of
several places the best counts, a tie changes nothing; very long texts are searched whole; an empty table on either side
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.functions.text import let
from leafloom.llm._common import Scratch, documents, text_of

WINDOW, LEAST_COVERAGE, LEAST_CONSISTENT = 5, 0.8, 0.8
#: Distinct benchmark windows up to this number are broadcast (8 bytes each); beyond it the join shuffles.
MOST_BROADCAST = 2_000_000
#: Units that are a slot after a number.
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t oz lb ml cl l hl s sec min h hr hrs ms day days week weeks month months year years hour hours "
    "minute minutes second seconds meter meters metre metres mile miles gram grams liter liters litre litres dollar dollars cent cents "
    "euro euros pound pounds degree degrees percent usd eur gbp mph kmh kb mb gb tb hz khz mhz ghz w kw v a"
).split()
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = "0", "1u", "2n"


def _spaced(text: Column) -> Column:
    """A unit written onto its number becomes a word of its own."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, rf"(?<=[0-9])(?=(?:{'|'.join(UNITS)})(?![\p{{L}}0-9]))", " ")).otherwise(text)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{M}0-9]+"), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """Words without signs, place by place those of ``template_words``."""
    return _words(F.lower(F.regexp_replace(_spaced(text), r"(?<=[0-9])[.,](?=[0-9])", "")))


def template_words(text: Column, inside: bool = False) -> Column:
    """Words with placeholders; ``inside``: without names that begin a sentence or a quotation."""
    digits = text.rlike("[0-9]")
    out = _spaced(text)
    out = F.regexp_replace(out, r"(?<=[\p{L}0-9,;:] )\p{Lu}\p{L}*" if inside else r"(?<![\p{L}\p{M}0-9])\p{Lu}\p{L}*", NAME_SLOT.replace("2", ""))
    numbers = F.regexp_replace(F.regexp_replace(out, r"[0-9]+(?:[.,][0-9]+)*", NUMBER_SLOT), rf"(?<=(?<![^\s])0[ ])(?i:{'|'.join(UNITS)})(?![\p{{L}}0-9])", UNIT_SLOT)
    out = F.when(digits, numbers).otherwise(out)
    return _words(F.translate(F.lower(out), "", "2"))


def windows(words: Column, plain: Column | None = None) -> Column:
    """Hashes of the windows of a list of words (a plain column: it is read for every place), in order."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    kind = [] if plain is None else [plain]
    return F.when(F.size(words) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)], *kind))).otherwise(F.array().cast("array<long>"))


def template_windows(words: Column) -> Column:
    """Those of an item that hold a word beside placeholders."""
    slot = lambda w: w.isin(NUMBER_SLOT, UNIT_SLOT, NAME_SLOT)
    every = F.transform(windows(words), lambda w, i: F.when(~F.forall(F.slice(words, i + 1, WINDOW), slot), w))
    return F.filter(every, lambda w: w.isNotNull())


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Of each item, by template and (``plain``) by words, the distinct windows: item_id, plain, own."""
    words = benchmark.where("item_id IS NOT NULL").select("item_id", template_words(text_of()).alias("words"), raw_words(text_of()).alias("raw"))
    own = [F.struct(F.lit(False).alias("plain"), F.array_distinct(template_windows(F.col("words"))).alias("own")), F.struct(F.lit(True).alias("plain"), F.array_distinct(windows(F.col("raw"), F.lit(True))).alias("own"))]
    kinds = words.select("item_id", F.explode(F.array(*own)).alias("k")).select("item_id", "k.plain", "k.own")
    return kinds.where(F.size("own") > 0).select("item_id", "plain", "own", F.xxhash64("own").alias("text_key")).distinct()


def covered(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, item_id, plain, coverage`` of pairs that share enough windows, by the words themselves where these do."""
    keys = items.select(F.explode("own").alias("window")).distinct()
    if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)  # size checked above
    words = docs.where("doc_id IS NOT NULL").select("doc_id", template_words(text_of()).alias("words"), raw_words(text_of()).alias("raw"))
    # outer: the filters that explode brings with it would make the windows again
    own = words.select("doc_id", F.explode_outer(F.concat(windows(F.col("words")), windows(F.col("raw"), F.lit(True)))).alias("window"))
    hits = scratch.stage(own.join(keys, "window").distinct(), "hits")

    key = ["item_id", "plain", "text_key"]
    often = hits.groupBy("window").agg(F.count(F.lit(1)).alias("often"))
    each = items.select(*key, F.size("own").alias("n_windows"), F.explode("own").alias("window")).join(often.hint("merge"), "window")
    found = each.groupBy(*key, "n_windows").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= LEAST_COVERAGE * F.col("n_windows"))
    # windows that no document holds are the rarest; of the others so many must be looked at
    asked = F.floor((1 - LEAST_COVERAGE) * F.col("n_windows") + 1e-9) + 1 - (F.col("n_windows") - F.col("found"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("often", "window"))
    probes = each.join(found.drop("n_windows"), key).withColumn("rank", rank).where(F.col("rank") <= asked).select(*key, "n_windows", "window")
    pairs = hits.join(probes.hint("merge"), "window").select("doc_id", *key, "n_windows").distinct()
    own = hits.groupBy("doc_id").agg(F.collect_set("window").alias("held"))  # windows of one document
    counted = pairs.join(own.hint("merge"), "doc_id").join(items.hint("merge"), key).select("doc_id", "item_id", "plain", (F.size(F.array_intersect("own", "held")) / F.col("n_windows")).alias("coverage"))
    return counted.where(F.col("coverage") >= LEAST_COVERAGE).groupBy("doc_id", "item_id").agg(F.max("plain").alias("plain"), F.max("coverage").alias("coverage"))


def slots(pairs: DataFrame) -> DataFrame:
    """Adds n_slots, n_changed and n_consistent to rows of doc_text and item_text that match, for the best shift between
    the two word lists among those that at least half as many windows have as the most frequent one.  Shifts are counted
    as runs of their sorted list, and equal parts of a text are compared once, so a text that repeats an item is as much
    work as it is long."""
    rows = pairs.select(
        "*", template_words(F.col("item_text")).alias("it"), raw_words(F.col("item_text")).alias("ir"), template_words(F.col("doc_text")).alias("dt"), raw_words(F.col("doc_text")).alias("dr"), template_words(F.col("item_text"), inside=True).alias("inner")
    )
    rows = rows.select("*", F.when(F.col("plain"), windows(F.col("ir"))).otherwise(windows(F.col("it"))).alias("iw"), F.when(F.col("plain"), windows(F.col("dr"))).otherwise(windows(F.col("dt"))).alias("dw"))
    shifts = F.filter(F.transform("dw", lambda w, j: F.when(F.array_contains("iw", w), j + 1 - F.array_position("iw", w).cast("int"))), lambda s: s.isNotNull())
    rows = rows.withColumn("shifts", F.array_sort(shifts))
    begins = F.filter(F.sequence(F.lit(0), F.size("shifts") - 1), lambda k: (k == 0) | (F.get("shifts", k) != F.get("shifts", k - 1)))
    rows = rows.withColumn("begins", F.when(F.size("shifts") > 0, begins).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("counts", F.transform("begins", lambda b, k: F.struct((F.coalesce(F.get("begins", k + 1), F.size("shifts")) - b).alias("n"), F.get("shifts", b).alias("s"))))
    is_slot = lambda w: w.isin(NUMBER_SLOT, UNIT_SLOT, NAME_SLOT)

    def checked(shift: Column) -> Column:
        doc = lambda i: F.when(shift + i >= 0, F.get("dr", shift + i))
        # a capitalised word that only begins a sentence is a slot where it changed
        slot = lambda w, i: is_slot(w) & (is_slot(F.get("inner", i)) | ~F.get("ir", i).eqNullSafe(doc(i)))
        at = F.filter(F.transform("it", lambda w, i: F.when(slot(w, i), i)), lambda i: i.isNotNull())
        values = F.transform(at, lambda i: F.struct((F.get("it", i) == NAME_SLOT).alias("name"), F.get("ir", i).alias("item"), doc(i).alias("doc")))

        def counted(v: Column) -> Column:
            apart = lambda a, b: ((a["item"] == b["item"]) & ~a["doc"].eqNullSafe(b["doc"])) | (a["name"] & b["name"] & (a["item"] != b["item"]) & a["doc"].eqNullSafe(b["doc"]))
            distinct = F.array_distinct(v)
            good = F.size(F.filter(v, lambda a: a["doc"].isNotNull() & ~F.exists(distinct, lambda b: apart(a, b))))
            changed = F.size(F.filter(v, lambda a: ~a["item"].eqNullSafe(a["doc"])))
            share = F.when(F.size(v) > 0, good / F.size(v)).otherwise(F.lit(1.0))
            return F.struct(share.alias("share"), (-changed).alias("same"), F.size(v).alias("n_slots"), changed.alias("n_changed"), good.alias("n_consistent"))

        return F.get(F.transform(F.array(values), counted), F.lit(0))

    # place by place: a slice would copy the whole text for each shift
    beside = lambda s: F.transform("it", lambda w, i: F.when(s + i >= 0, F.get("dr", s + i)))
    often = F.transform(let(F.array_max("counts")["n"], lambda most: F.filter("counts", lambda c: 2 * c["n"] >= most)), lambda c: F.struct(F.xxhash64(beside(c["s"])).alias("h"), c["s"].alias("s")))
    rows = rows.withColumn("often", F.array_sort(often))
    rows = rows.withColumn("apart", F.filter("often", lambda o, k: (k == 0) | (o["h"] != F.get("often", k - 1)["h"])))
    best = F.array_max(F.transform("apart", lambda o: checked(o["s"])))
    return rows.withColumn("best", best).select(*[c for c in pairs.columns if c != "plain"], "best.n_slots", "best.n_changed", "best.n_consistent")


def short_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """Documents that hold an item of two to four words at any place, or one of a single word as a line; None where there
    are no such items."""
    words = raw_words(text_of())
    short = benchmark.where("item_id IS NOT NULL").select("item_id", words.alias("w")).where(F.size("w").between(1, WINDOW - 1)).select("item_id", F.size("w").alias("n"), F.array_join("w", " ").alias("line"))
    if short.isEmpty():
        return None
    named = docs.where("doc_id IS NOT NULL")
    lines = named.select("doc_id", F.explode(F.split(text_of(), "\n")).alias("text")).select("doc_id", raw_words(F.col("text")).alias("w"))
    lines = lines.where(F.size("w") == 1).select("doc_id", F.lit(1).alias("n"), F.get("w", F.lit(0)).alias("line")).distinct()
    found = lines.join(short.where("n = 1"), ["n", "line"]).select("doc_id", "item_id")
    longer = short.where("n > 1").select("item_id", "n", "line", F.split("line", " ")[0].alias("first"))
    if not longer.isEmpty():
        # a row for each word, which meets the items that begin with it; only those rows get the words after it
        own = named.select("doc_id", words.alias("w")).where(F.size("w") > 1)
        firsts = longer.select("first").distinct()
        if firsts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
            firsts = F.broadcast(firsts)  # size checked above
        ahead = F.transform("w", lambda x, i: F.struct(x.alias("first"), F.slice("w", i + 1, WINDOW - 1).alias("next")))
        starts = own.select("doc_id", F.explode(ahead).alias("a")).select("doc_id", "a.first", "a.next").join(firsts, "first", "left_semi")
        sizes = F.explode(F.sequence(F.lit(2), F.least(F.lit(WINDOW - 1), F.size("next")))).alias("n")
        starts = starts.where(F.size("next") > 1).select("doc_id", "next", sizes).select("doc_id", "n", F.array_join(F.slice("next", 1, F.col("n")), " ").alias("line")).distinct()
        found = found.unionByName(starts.join(longer.select("item_id", "n", "line"), ["n", "line"]).select("doc_id", "item_id"))
    zero = F.lit(0)
    return found.distinct().select("doc_id", "item_id", F.lit(1.0).alias("coverage"), zero.alias("n_slots"), zero.alias("n_changed"), zero.alias("n_consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, coverage, n_slots, n_changed, n_consistent."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.stage(benchmark_windows(benchmark), "items")
    pairs = scratch.stage(covered(docs, items, scratch), "pairs")
    scratch.drop("hits")
    texts = docs.select("doc_id", text_of().alias("doc_text"))
    found = pairs.join(texts, "doc_id").join(benchmark.select("item_id", text_of().alias("item_text")), "item_id")
    # staged before the filter: pushed below, it would repeat the whole chain of expressions for every value
    checked = scratch.stage(slots(found).drop("doc_text", "item_text"), "checked").where(F.col("n_consistent") >= LEAST_CONSISTENT * F.col("n_slots"))
    short = short_items(docs, benchmark)
    out = checked if short is None else checked.unionByName(short)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("coverage", "n_slots", "n_changed", "n_consistent")])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without doc_id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
