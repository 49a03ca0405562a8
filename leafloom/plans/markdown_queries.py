"""Queries over real Markdown: a text of known structure is made from each document, parsed by the library, and compared with
what the structure says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import entities, evaluate, search, tree, vectors, xrefs
from leafloom.plans import adapters as A
from leafloom.plans.queries import TOKENS, query
from leafloom.sources import files, markdown

#: The pieces of the Markdown text of a document between the two that come from it: each begins with its heading.
PIECES = [
    "# Doc {id}\n\nIntro words of `load_table` here.\n\n",
    "## 1. First Part\n\n{a}\n\nSee [more](#details) and Section 2 for it.\n\n",
    "## 2. Second Part\n\nThe **Blue Term** is kept. {b}\n\n",
    "### Details\n\n```\n# no heading\nload_table(1)\n```\n\n",
    "### Details\n\nBlue Term again.\n",
]


def _sql_piece(piece: str) -> str:
    parts = piece.replace("\n", "\x00N\x00").replace("{id}", "\x00I\x00").replace("{a}", "\x00A\x00").replace("{b}", "\x00B\x00").split("\x00")
    names = {"N": "chr(10)", "I": "doc_id", "A": "a", "B": "b"}
    return " || ".join(names.get(p) or f"'{p}'" for p in parts if p)


_CUT = "trim(lower(regexp_replace(substr(coalesce(text, ''), {0}, 120), '[^A-Za-z]+', ' ', 'g')))"
#: s: the sections that the structure has, with the pieces' offsets (the text is ASCII, so bytes are characters).
SQL_MD = f"""d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_CUT.format(1)} AS a, {_CUT.format(121)} AS b FROM documents),
q AS (SELECT doc_id, [{", ".join(_sql_piece(p) for p in PIECES)}] AS ps FROM d),
s AS (SELECT doc_id, i AS pos, ['', '1-first-part', '2-second-part', '2-second-part/details', '2-second-part/details-2'][i + 1] AS tail, [1, 2, 2, 3, 3][i + 1] AS level,
  CASE i WHEN 0 THEN 'Doc ' || doc_id ELSE ['1. First Part', '2. Second Part', 'Details', 'Details'][i] END AS title, CASE WHEN i < 3 THEN NULLIF(['', 'x', 'x'][i + 1], '') END AS top,
  CAST(coalesce(list_sum([length(p) FOR p IN ps[1:i]]), 0) AS INT) AS a, CAST(list_sum([length(p) FOR p IN (CASE i WHEN 0 THEN ps WHEN 1 THEN ps[1:2] WHEN 2 THEN ps WHEN 3 THEN ps[1:4] ELSE ps END)]) AS INT) AS z,
  substr(ps[i + 1], instr(ps[i + 1], chr(10)) + 1) AS raw FROM q, UNNEST(range(5)) u(i)),
t AS (SELECT *, 'doc-' || doc_id || CASE WHEN tail = '' THEN '' ELSE '/' || tail END AS section_id,
  CASE WHEN pos = 0 THEN NULL WHEN pos < 3 THEN 'doc-' || doc_id ELSE 'doc-' || doc_id || '/2-second-part' END AS parent FROM s)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents")
    cut = lambda at: F.trim(F.lower(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), at, 120), "[^A-Za-z]+", " ")))
    values = {"{id}": F.col("doc_id").cast("string"), "{a}": cut(1), "{b}": cut(121)}
    out = F.lit("".join(PIECES))
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), value)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), out.alias("text"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.parse(texts(spark, sf_dir))


@query(
    "md_sections",
    f"""WITH {SQL_MD} SELECT doc_id, pos, section_id, title, level, parent, a AS start, z AS "end", raw AS raw_text,
    CASE WHEN pos = 0 THEN title WHEN pos < 3 THEN 'Doc ' || doc_id || '>' || title ELSE 'Doc ' || doc_id || '>2. Second Part>' || title END AS path,
    CASE pos WHEN 0 THEN section_id || '/1-first-part|' || section_id || '/2-second-part' WHEN 2 THEN section_id || '/details|' || section_id || '/details-2' ELSE '' END AS children FROM t""",
)
def md_sections(spark, sf):
    """Lines to headings, tree, ids, spans, bodies, paths and children."""
    rows = sections(spark, sf)
    return rows.select("doc_id", "pos", "section_id", "title", "level", "parent", "span.start", "span.end", "raw_text", F.array_join("path", ">").alias("path"), F.array_join("children", "|").alias("children"))


@query("md_links", f"WITH {SQL_MD} SELECT doc_id, section_id AS src, 'doc-' || doc_id || '/2-second-part/details' AS dst, 0.95::DOUBLE AS confidence, instr(raw, '(#details)') + 1 AS start, instr(raw, '(#details)') + 8 AS \"end\" FROM t WHERE pos = 1")
def md_links(spark, sf):
    return xrefs.links(sections(spark, sf)).select("doc_id", "src", "dst", "confidence", "span.start", "span.end")


@query("md_textual", f"WITH {SQL_MD} SELECT doc_id, section_id AS src, 'doc-' || doc_id || '/2-second-part' AS dst, 0.7::DOUBLE AS confidence, instr(raw, 'Section 2') + 7 AS start, instr(raw, 'Section 2') + 8 AS \"end\" FROM t WHERE pos = 1")
def md_textual(spark, sf):
    return xrefs.textual(sections(spark, sf)).select("doc_id", "src", "dst", "confidence", "span.start", "span.end")


_EDGES = """e AS (SELECT doc_id, 'doc-' || doc_id || '/1-first-part' AS src, 'doc-' || doc_id || '/2-second-part/details' AS dst, 'link' AS kind, 0.95::DOUBLE AS confidence FROM d
  UNION ALL SELECT doc_id, 'doc-' || doc_id || '/1-first-part', 'doc-' || doc_id || '/2-second-part', 'textual', 0.7 FROM d
  UNION ALL SELECT doc_id, 'doc-' || doc_id || '/2-second-part', 'doc-' || doc_id || '/2-second-part/details-2', 'entity', 0.5 FROM d
  UNION ALL SELECT doc_id, 'doc-' || doc_id || '/2-second-part/details-2', 'doc-' || doc_id || '/2-second-part', 'entity', 0.5 FROM d)"""


def _entities(rows: DataFrame) -> DataFrame:
    return entities.fold(entities.hits(rows))


@query("md_xrefs", f"WITH {SQL_MD}, {_EDGES} SELECT doc_id, src, dst, kind, round(confidence, 6) AS confidence FROM e")
def md_xrefs(spark, sf):
    """All three extractors, one edge for each pair and kind."""
    rows = sections(spark, sf)
    return xrefs.extract(rows, _entities(rows)).select("doc_id", "src", "dst", "kind", F.round("confidence", 6).alias("confidence"))


@query("md_outgoing", f"WITH {SQL_MD}, {_EDGES} SELECT doc_id, dst, kind, round(confidence, 6) AS confidence FROM e WHERE doc_id = '7' AND src = 'doc-7/1-first-part'")
def md_outgoing(spark, sf):
    return xrefs.outgoing(xrefs.extract(sections(spark, sf)), "7", "doc-7/1-first-part").select("doc_id", "dst", "kind", F.round("confidence", 6).alias("confidence"))


@query("md_incoming", f"WITH {SQL_MD}, {_EDGES} SELECT doc_id, src, kind, round(confidence, 6) AS confidence FROM e WHERE doc_id = '7' AND dst = 'doc-7/2-second-part' AND kind <> 'entity'")
def md_incoming(spark, sf):
    return xrefs.incoming(xrefs.extract(sections(spark, sf)), "7", "doc-7/2-second-part").select("doc_id", "src", "kind", F.round("confidence", 6).alias("confidence"))


@query(
    "md_vocabulary",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents) SELECT doc_id, v.c AS canonical, v.k AS kind, v.s AS case_sensitive FROM d,
    (VALUES ('load_table', 'code', TRUE), ('Blue Term', 'defined', FALSE), ('Details', 'defined', TRUE)) v(c, k, s)""",
)
def md_vocabulary(spark, sf):
    return entities.vocabulary(sections(spark, sf)).select("doc_id", "canonical", "kind", "case_sensitive")


@query(
    "md_entities",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, v.o AS ent_ord, v.c AS canonical, v.k AS kind, v.c AS surface_forms, 2 AS n_mentions FROM documents, (VALUES (0, 'load_table', 'code'), (1, 'Blue Term', 'defined')) v(o, c, k)""",
)
def md_entities(spark, sf):
    return _entities(sections(spark, sf)).select("doc_id", "ent_ord", "canonical", "kind", F.array_join("surface_forms", "|").alias("surface_forms"), F.size("mentions").alias("n_mentions"))


@query(
    "md_mentions",
    f"""WITH {SQL_MD} SELECT doc_id, 'Blue Term' AS canonical, CAST(pos = 4 AS INT) AS ord, section_id, title, instr(raw, 'Blue Term') - 1 AS start, instr(raw, 'Blue Term') + 8 AS "end" FROM t WHERE pos IN (2, 4)""",
)
def md_mentions(spark, sf):
    rows = sections(spark, sf)
    return entities.find_mentions(_entities(rows), rows, "blue term").select("doc_id", "canonical", "ord", "section_id", "title", "span.start", "span.end")


_CONTENT = "'## ' || title || chr(10) || chr(10) || raw"


@query(
    "md_read_range",
    f"""WITH {SQL_MD}, c AS (SELECT *, {_CONTENT} AS content FROM t WHERE doc_id = '3' AND pos BETWEEN 1 AND 3), k AS (SELECT *, {TOKENS.format('content')} AS tokens FROM c),
    r AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY pos) AS BIGINT) AS total FROM k), f AS (SELECT *, total <= 70 OR pos = 1 AS keep FROM r)
    SELECT doc_id, pos, section_id, content, tokens, total, (SELECT min_by(section_id, pos) FROM f WHERE NOT keep) AS next_id FROM f WHERE keep""",
)
def md_read_range(spark, sf):
    """One document's range within a token budget."""
    return tree.read_range(sections(spark, sf), "3", "doc-3/1-first-part", "doc-3/2-second-part/details", 70)


def _words(n: int) -> str:
    return f"array_to_string(W[1:{n}], ' ') || CASE WHEN len(W) > {n} THEN '…' ELSE '' END"


@query(
    "md_get_section",
    f"""WITH {SQL_MD}, w AS (SELECT *, [x FOR x IN string_split_regex(raw, '\\s+') IF x <> ''] AS W FROM t WHERE doc_id = '3' AND pos = 2)
    SELECT doc_id, section_id, title, 'Doc 3>2. Second Part' AS path, {_words(15)} AS content, TRUE AS has_children, 'synopsis,digest,full' AS next_levels FROM w""",
)
def md_get_section(spark, sf):
    rows = sections(spark, sf)
    found = tree.get_section(rows, tree.build_summaries(rows), "3", "doc-3/2-second-part", "gist")
    return found.select("doc_id", "section_id", "title", F.array_join("path", ">").alias("path"), "content", "has_children", F.array_join("next_levels", ",").alias("next_levels"))


@query(
    "md_summaries",
    f"""WITH {SQL_MD}, w AS (SELECT *, [x FOR x IN string_split_regex(raw, '\\s+') IF x <> ''] AS W FROM t) SELECT doc_id, section_id, {_words(15)} AS gist, {_words(60)} AS synopsis,
    CASE WHEN len(W) >= 12 THEN {_words(200)} END AS digest FROM w""",
)
def md_summaries(spark, sf):
    return tree.build_summaries(sections(spark, sf), digest_from=12).select("doc_id", "section_id", "gist", "synopsis", "digest")


@query("within_budget", "WITH w AS (SELECT doc_id, coalesce(text, '') AS t, [x FOR x IN string_split_regex(coalesce(text, ''), '\\s+') IF x <> ''] AS W FROM documents) SELECT doc_id, CASE WHEN len(W) <= 20 THEN t ELSE array_to_string(W[1:20], ' ') || '…' END AS short FROM w")
def within_budget(spark, sf):
    """Whole texts cut to the budget of a gist."""
    return A.table(spark, sf, "documents").select("doc_id", T.within_budget(F.coalesce("text", F.lit("")), "gist").alias("short"))


@query(
    "md_vectors",
    f"""WITH {SQL_MD}, w AS (SELECT doc_id, section_id, unnest([x FOR x IN string_split_regex(lower(title || chr(10) || chr(10) || trim(raw, ' ')), '\\s+') IF x <> '']) AS word FROM t),
    b AS (SELECT doc_id, section_id, CAST(('0x' || substr(sha256(word), 1, 16))::UBIGINT % 16 AS INT) AS bucket, count(*) AS n FROM w GROUP BY ALL)
    SELECT doc_id, section_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, section_id)), 5) AS value FROM b""",
)
def md_vectors(spark, sf):
    """Offline vectors of all sections, as the sparse rows of their values."""
    rows = vectors.build(sections(spark, sf), 16).select("doc_id", "section_id", F.posexplode("vector").alias("bucket", "v")).where("v <> 0")
    return rows.select("doc_id", "section_id", "bucket", F.round(F.col("v").cast("double"), 5).alias("value"))


@query(
    "md_semantic",
    f"""WITH {SQL_MD}, w AS (SELECT doc_id, section_id, title, unnest([x FOR x IN string_split_regex(lower(title || chr(10) || chr(10) || trim(raw, ' ')), '\\s+') IF x <> '']) AS word FROM t),
    b AS (SELECT doc_id, section_id, title, CAST(('0x' || substr(sha256(word), 1, 16))::UBIGINT % 16 AS INT) AS bucket, count(*) AS n FROM w GROUP BY ALL),
    v AS (SELECT *, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, section_id)) AS FLOAT) AS x FROM b)
    SELECT doc_id, section_id, title, round(sum(x / 4.0::DOUBLE), 4) AS score FROM v GROUP BY ALL ORDER BY sum(x / 4.0::DOUBLE) DESC, section_id, doc_id LIMIT 8""",
)
def md_semantic(spark, sf):
    """The k sections nearest to a vector of equal values, with their strongest windows."""
    rows = sections(spark, sf)
    return vectors.search_semantic(vectors.build(rows, 16), rows, [1.0] * 16, "blue term details", 8).select("doc_id", "section_id", "title", F.round("score", 4).alias("score"))


@query(
    "md_shared_edges",
    f"""WITH {SQL_MD}, p AS (SELECT doc_id, section_id, parent AS n_section, 'p' AS k FROM t WHERE parent IS NOT NULL), x AS (
      SELECT doc_id, 'doc-' || doc_id || '/1-first-part' AS section_id, 'doc-' || doc_id || '/2-second-part/details' AS n_section, 0.95::DOUBLE AS w FROM d
      UNION ALL SELECT doc_id, 'doc-' || doc_id || '/1-first-part', 'doc-' || doc_id || '/2-second-part', 0.7 FROM d
      UNION ALL SELECT doc_id, section_id, n_section, {search.PARENT_WEIGHT} FROM p)
    SELECT doc_id, section_id, n_section, round(max(w), 6) AS weight FROM (SELECT * FROM x UNION ALL SELECT doc_id, n_section, section_id, w FROM x) GROUP BY ALL""",
)
def md_shared_edges(spark, sf):
    """Symmetric edges of parents and references."""
    rows = A.staged(sections(spark, sf).select("doc_id", "pos", "section_id", "title", "parent", "raw_text"), "sections")  # read for each end of an edge
    return search.graph_edges(rows, xrefs.extract(rows)).select("doc_id", "section_id", "n_section", F.round("weight", 6).alias("weight"))


@query(
    "document_ids",
    """WITH s AS (SELECT DISTINCT lang || '/Doc ' || (doc_id % 97) || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.MD' END AS source FROM documents WHERE lang IS NOT NULL),
    b AS (SELECT source, trim(regexp_replace(lower(regexp_replace(source, '\\.[^./]+$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY source) AS n FROM b) SELECT source, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM n""",
)
def document_ids(spark, sf):
    """Paths to ids; each slug stands for two paths."""
    docs = A.table(spark, sf, "documents").where("lang IS NOT NULL")
    source = F.concat("lang", F.lit("/Doc "), (F.col("doc_id") % 97).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".MD"))
    return files.document_ids(docs.select(source.alias("source")).distinct()).select("source", "id")


@query(
    "chunk_texts",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS W FROM documents), k AS (SELECT doc_id, i AS chunk, W[i * 50 + 1:i * 50 + 50] AS c FROM w, UNNEST(range((len(W) + 49) // 50)) u(i))
    SELECT doc_id, chunk, len(c) AS n_words, c[1] AS first, c[len(c)] AS last, sha256(array_to_string(c, ' ')) AS hash FROM k""",
)
def chunk_texts(spark, sf):
    """Chunks of 50 words of whole texts."""
    rows = evaluate.chunks(A.table(spark, sf, "documents"), 50).withColumn("w", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return rows.select("doc_id", "chunk", F.size("w").alias("n_words"), F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"), F.sha2(F.array_join("w", " "), 256).alias("hash"))


@query("tree_faults", "SELECT v.doc_id, v.section_id, v.problem FROM (VALUES ('0', 'africa', 'duplicate id'), ('1', 'lost/parent', 'unknown parent'), ('2', 'lost-child', 'unknown child'), ('3', 'deep', 'out of range')) v(doc_id, section_id, problem)")
def tree_faults(spark, sf):
    """The tree of regions with one fault of each kind put in: the first heading again, and three times with a fault."""
    rows = A.tree(spark, sf)
    fault = F.explode(F.when(F.expr("doc_id = '0' AND pos = 0"), F.sequence(F.lit(0), F.lit(4))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("fault", fault)
    none, odd = F.array().cast("array<string>"), F.struct(F.lit(5).alias("start"), F.lit(1).alias("end"))
    put = {"doc_id": ("1", "2", "3"), "section_id": ("other", "other", "deep"), "parent": ("lost/parent", None, None), "children": (none, F.array(F.lit("lost-child")), none), "span": (None, None, odd)}
    for name, values in put.items():
        made = F.col(name)
        for k, value in enumerate(values):
            if value is not None:
                made = F.when(F.col("fault") == k + 2, value).otherwise(made)
        rows = rows.withColumn(name, made)
    return tree.validate(rows.drop("fault"))


#: Blocks that hold a line's words {t}, and the heading's level if they are one; each stands after a paragraph of its own.
BLOCKS = [
    ("# {t} ##", 1), ("{t}\n===", 1), ("> ## {t}", 2), ("- item\n\n  ### {t}", 3), ("```\n# {t}\n```", None), ("    # {t}", None), ("{t}\n---", 2), ("#{t}", None), ("1. #### **{t}**", 4), ("> {t}\n---", None),
    ("| {t} | b |\n|---|---|\n| c | d |\n---", None), ("[{t}]: /url\n===", None), ("- > 1. ##### `{t}`", 5), ("- ~~~\n  # {t}", None), ("~~~~\n{t}\n~~~\n# {t}\n~~~~", None), ("{t}\n- last\n  ===", 1),
]
TITLES = {15: "last"}
SQL_BLOCKS = """b AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, i, CASE WHEN t = '' THEN 'x' ELSE t END AS t, (length(line) + i) % {n} AS kind FROM (
  SELECT doc_id, i, line, array_to_string([w FOR w IN string_split(regexp_replace(lower(line), '[^a-z]+', ' ', 'g'), ' ') IF w <> ''][1:8], ' ') AS t
  FROM (SELECT doc_id, i, ls[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), UNNEST(range(len(ls))) u(i)) WHERE trim(line) <> ''))""".format(n=len(BLOCKS))


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each document with a block for each of its lines, of a kind that depends on the line."""
    lines = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.trim("line") != "")
    words = F.array_join(F.slice(F.filter(F.split(F.regexp_replace(F.lower("line"), "[^a-z]+", " "), " "), lambda w: w != ""), 1, 8), " ")
    made = F.lit("")
    kind = (F.length("line") + F.col("i")) % len(BLOCKS)
    for k, (block, _) in enumerate(BLOCKS):
        made = F.when(kind == k, F.replace(F.lit("p\n\n" + block + "\n\n"), F.lit("{t}"), F.when(words == "", "x").otherwise(words))).otherwise(made)
    rows = lines.select("doc_id", "i", made.alias("block"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda b: b["block"]), "").alias("text"))  # one document's lines


@query(
    "md_blocks",
    f"""WITH {SQL_BLOCKS}, h AS (SELECT doc_id, i, t, CASE kind {" ".join(f"WHEN {k} THEN {level}" for k, (_, level) in enumerate(BLOCKS) if level)} END AS level, CASE kind {" ".join(f"WHEN {k} THEN '{v}'" for k, v in TITLES.items())} ELSE t END AS title FROM b)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, level, title FROM h WHERE level IS NOT NULL""",
)
def md_blocks(spark, sf):
    """Headings of texts whose structure differs from line to line: setext, quotes, list items, fences, tables, definitions."""
    return markdown.parse(A.staged(block_texts(spark, sf), "texts")).select("doc_id", "pos", "level", "title")


SQL_ANCHORS = """l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, i, [w FOR w IN string_split(regexp_replace(lower(ls[i + 1]), '[^a-z]+', ' ', 'g'), ' ') IF w <> ''] AS W
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), UNNEST(range(len(ls))) u(i)),
k AS (SELECT doc_id, W, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM l WHERE len(W) > 1),
o AS (SELECT *, CASE WHEN pos % 3 > 0 THEN pos - pos % 3 END AS up, W[1] || CASE WHEN row_number() OVER (PARTITION BY doc_id, CASE WHEN pos % 3 > 0 THEN pos - pos % 3 END, W[1] ORDER BY pos) = 1 THEN ''
  ELSE '-' || row_number() OVER (PARTITION BY doc_id, CASE WHEN pos % 3 > 0 THEN pos - pos % 3 END, W[1] ORDER BY pos) END AS own FROM k),
t AS (SELECT o.*, concat_ws('/', p.own, o.own) AS section_id FROM o LEFT JOIN o p ON p.doc_id = o.doc_id AND p.pos = o.up)"""


@query(
    "md_anchors",
    f"""WITH {SQL_ANCHORS}, c AS (SELECT doc_id, own, count(*) AS n FROM t GROUP BY ALL)
    SELECT DISTINCT a.doc_id, a.section_id AS src, b.section_id AS dst, CASE WHEN n = 1 THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence
    FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.own = a.W[2] JOIN c ON c.doc_id = b.doc_id AND c.own = b.own WHERE a.section_id <> b.section_id""",
)
def md_anchors(spark, sf):
    """Links to sections whose titles repeat in a document, so that many anchors are ambiguous: a section for each line, titled
    by its first word and linked to by its second."""
    lines = A.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    words = F.filter(F.split(F.regexp_replace(F.lower("line"), "[^a-z]+", " "), " "), lambda w: w != "")
    lines = lines.select("doc_id", "i", words.alias("w")).where(F.size("w") > 1)
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("ls"))  # one document's lines
    part = lambda x, k: F.concat(F.when(k % 3 == 0, "# ").otherwise("## "), x["w"][0], F.lit("\n\n"), F.array_join(x["w"], " "), F.lit(" [it](#"), x["w"][1], F.lit(")\n\n"))
    texts = rows.select("doc_id", F.array_join(F.transform("ls", part), "").alias("text"))
    found = xrefs.dedupe(xrefs.links(A.staged(markdown.parse(A.staged(texts, "texts")), "sections")))  # read for both ends of a link
    return found.select("doc_id", "src", "dst", "confidence")
