"""Entities: a vocabulary by document and a scan for its mentions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns and word lists of the extraction rules.
FENCE = r"```[^\n]*\n(?s:.*?)\n```"
INLINE = r"`([^`\n]+)`"
BOLD = r"\*\*([^*\n]+)\*\*"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]{2,}"
PROPER = r"[A-Z][A-Za-z0-9]+(?:[ \t]+[A-Z][A-Za-z0-9]+)+"
CODE_STOPS = (
    "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try "
    "while with yield True False None self cls int str float bool list dict tuple set type any all len range print const let var function this new throw void typeof "
    "instanceof switch case default extends the that into"
).split()
HEADING_STOPS = [
    "overview", "introduction", "intro", "summary", "abstract", "scope", "motivation", "background", "context", "decision", "consequences", "alternatives considered",
    "open questions", "goals", "non-goals", "usage", "example", "examples", "getting started", "quick start", "installation", "configuration", "inputs", "input", "output",
    "outputs", "parameters", "returns", "semantics", "errors", "error", "status", "notes", "note", "see also", "references", "reference", "api", "changelog", "contributing",
    "license", "faq", "glossary", "steps", "verification", "prerequisites", "requirements", "results", "discussion", "methodology", "conclusion", "appendix", "definitions",
    "table of contents", "contents", "related", "links",
]
CONNECTORS = "of the a an and or to for in on with by".split()
LEADING_STOPS = (
    "The A An This That These Those It Its We You They He She If When While Then Per See Use For And But Or Nor So As At By In On Of To From With Each Every All Any Some "
    "No Not Here There Where Why How What Which Who Because Internal"
).split()
MOST_LETTERS, MOST_WORDS = 80, 6
PRIORITY = {"code": 3, "defined": 2, "proper": 1, "term": 0}
MARKS = "[.,;:!?]"
HITS = "section_id string, canonical string, surface_form string, kind string, start int, end int"


def code_terms(text: Column) -> Column:
    """Identifiers in fences, then those in inline code outside fences."""
    fenced = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), lambda f: F.regexp_extract_all(F.regexp_replace(f, r"^```[^\n]*\n|\n```$", ""), F.lit(IDENTIFIER), F.lit(0))))
    rest = F.regexp_replace(text, FENCE, "\n")
    inline = F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(INLINE), F.lit(1)), lambda c: F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))))
    return F.filter(F.concat(fenced, inline), lambda t: ~t.isin(*CODE_STOPS))


def bold_terms(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(BOLD), F.lit(1)), lambda t: F.trim(t))
    return F.filter(found, lambda t: (t != "") & (F.length(t) <= MOST_LETTERS) & ~t.rlike(MARKS))


def proper_terms(text: Column) -> Column:
    """Title-case runs outside fences without leading stop words, of two words or more that are not all connectors."""
    found = F.regexp_extract_all(F.regexp_replace(text, FENCE, "\n"), F.lit(PROPER), F.lit(0))
    lead = "|".join(LEADING_STOPS)
    trimmed = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, "[ \\t]+", " "), rf"^(?:(?:{lead}) )+", ""))
    trimmed = F.transform(trimmed, lambda t: F.when(t.isin(*LEADING_STOPS), F.lit("")).otherwise(t))
    return F.filter(trimmed, lambda t: (F.size(F.split(t, " ")) > 1) & ~F.forall(F.split(F.lower(t), " "), lambda w: w.isin(*CONNECTORS)))


def heading_term(title: Column) -> Column:
    """The title where it names a thing, else null."""
    t = F.trim(title)
    w = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    upper = lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}")
    good = F.when(F.size(w) == 1, (F.length(t) > 2) & upper(t)).otherwise(F.forall(w, lambda x: upper(x) | F.lower(x).isin(*CONNECTORS)))
    return F.when((t != "") & ~t.rlike(MARKS) & F.size(w).between(1, MOST_WORDS) & ~F.regexp_replace(F.lower(t), r"\s+", " ").isin(*HEADING_STOPS) & good, t)


def vocabulary(sections: DataFrame) -> DataFrame:
    """``doc_id, canonical, kind, case_sensitive``: one entry a key; the kind of higher priority wins, the first of equals."""
    b = F.col("raw_text")
    part = lambda terms, kind: F.transform(terms, lambda t, i: F.struct(F.lit(kind).alias("kind"), t.alias("name"), i.alias("i")))
    heading = F.filter(F.array(heading_term(F.col("title"))), lambda t: t.isNotNull())
    found = F.concat(part(code_terms(b), "code"), part(bold_terms(b), "defined"), part(proper_terms(b), "proper"), part(heading, "defined"))
    rows = sections.select("doc_id", "pos", F.posexplode_outer(found).alias("at", "t")).where("t IS NOT NULL").select("doc_id", "pos", "at", "t.kind", F.trim("t.name").alias("canonical"))
    several = F.col("canonical").rlike(r"\s")
    rows = rows.where((F.col("canonical") != "") & (several | (F.col("kind") == "proper") | F.col("canonical").rlike(r"[\p{Lu}0-9_]")))
    rows = rows.withColumn("case_sensitive", ~several).withColumn("key", F.when(several, F.regexp_replace(F.lower("canonical"), r"\s+", " ")).otherwise(F.col("canonical")))
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")]
    best = Window.partitionBy("doc_id", "key").orderBy(rank.desc(), "pos", "at")
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("doc_id", "canonical", "kind", "case_sensitive", "pos", "at")


def _scan(batches: Iterator) -> Iterator:
    """Mentions of a document's vocabulary, which is its first row, in the texts of its other rows: longest surface first,
    whole words, without overlap."""
    import re

    import pyarrow as pa

    fence, inline = re.compile(r"```[^\n]*\n(.*?)\n```", re.S), re.compile(INLINE)
    owner, pattern, by_key = None, None, {}
    for batch in batches:
        out = []
        for doc, pos, section, text, terms in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if terms is not None:
                owner, by_key = doc, {}
                for t in terms:
                    by_key.setdefault(" ".join(t["canonical"].lower().split()), []).append(t)
                surfaces = sorted((t["canonical"] for t in terms), key=len, reverse=True)
                pattern = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(r"\s+".join(map(re.escape, s.split())) for s in surfaces) + ")(?![A-Za-z0-9_])", re.I)
                continue
            if doc != owner or not text:
                continue
            fences = [m.span() for m in fence.finditer(text)]
            code = [m.span(1) for m in fence.finditer(text)] + [m.span(1) for m in inline.finditer(text) if not any(a <= m.start() < b for a, b in fences)]
            for m in pattern.finditer(text):
                near = by_key.get(" ".join(m[0].lower().split()), [])
                exact = [t for t in near if t["case_sensitive"] and t["canonical"] == m[0]]
                term = next(iter(exact or [t for t in near if not t["case_sensitive"]]), None)
                if term and (term["kind"] != "code" or any(a <= m.start() < b for a, b in code)):
                    out.append((doc, pos, section, term["canonical"], m[0], term["kind"], m.start(), m.end()))
        names = ["doc_id", "pos", "section_id", "canonical", "surface_form", "kind", "start", "end"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types[k]) for k in range(8)], names=names)


def hits(sections: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """All mentions with offsets inside ``raw_text``, in order (``hit_ord`` by document)."""
    vocab = vocabulary(sections) if vocab is None else vocab
    terms = vocab.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "canonical", "kind", "case_sensitive"))).alias("terms"))
    # a document's vocabulary goes once, before its sections
    first = terms.select("doc_id", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("raw_text"), "terms")
    own = sections.select("doc_id", F.col("pos").cast("int").alias("pos"), "section_id", "raw_text", F.lit(None).cast(terms.schema["terms"].dataType).alias("terms"))
    rows = first.unionByName(own).withColumn("doc_id", F.col("doc_id").cast("string")).repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    found = rows.mapInArrow(_scan, "doc_id string, pos int, " + HITS)
    by = Window.partitionBy("doc_id").orderBy("pos", "start")
    return found.select("doc_id", (F.row_number().over(by) - 1).alias("hit_ord"), "section_id", "canonical", "surface_form", "kind", F.struct("start", "end").alias("span"))


def fold(found: DataFrame) -> DataFrame:
    """Mentions to entities by (canonical, kind), in first-seen order, with surface forms and mentions in order."""
    ordered = F.array_sort(F.collect_list(F.struct("hit_ord", "section_id", "span", "surface_form")))
    rows = found.groupBy("doc_id", "canonical", "kind").agg(F.min("hit_ord").alias("first"), ordered.alias("h"))
    by = Window.partitionBy("doc_id").orderBy("first", "canonical", "kind")
    forms = F.array_distinct(F.transform("h", lambda x: x["surface_form"]))
    return rows.select("doc_id", (F.row_number().over(by) - 1).alias("ent_ord"), "canonical", "kind", forms.alias("surface_forms"), F.transform("h", lambda x: F.struct(x["section_id"].alias("section_id"), x["span"].alias("span"))).alias("mentions"))


def find_mentions(entities: DataFrame, sections: DataFrame, entity: str, scope: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Mentions of the entity named by canonical form, else by a surface form; unknown names give no rows."""
    from leafloom.functions import text as T

    name = entity.strip().lower()
    rank = F.when(F.lower("canonical") == name, 0).when(F.exists("surface_forms", lambda s: F.lower(s) == name), 1)
    own = entities.withColumn("rank", rank).where("rank IS NOT NULL")
    if kinds:
        own = own.where(F.col("kind").isin(*kinds))
    own = own.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "ent_ord"))).where("rn = 1")
    rows = own.select("doc_id", "canonical", "kind", F.posexplode("mentions").alias("ord", "m")).select("doc_id", "canonical", "kind", "ord", "m.section_id", "m.span")
    rows = rows.where(T.in_scope(F.col("section_id"), scope))
    return rows.join(sections.select("doc_id", "section_id", "title"), ["doc_id", "section_id"])


def by_kind(entities: DataFrame, kind: str) -> DataFrame:
    return entities.where(F.col("kind") == kind)


def by_section(entities: DataFrame, doc_id: str, section_id: str) -> DataFrame:
    return entities.where((F.col("doc_id") == doc_id) & F.exists("mentions", lambda m: m["section_id"] == section_id))


def one_per_section(sections: DataFrame) -> DataFrame:
    """A deterministic extractor for tests: each title is one entity of its section."""
    t = F.trim("title")
    return sections.where(t != "").select("doc_id", F.col("pos").alias("hit_ord"), "section_id", t.alias("canonical"), t.alias("surface_form"), F.lit("term").alias("kind"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")).alias("span"))
