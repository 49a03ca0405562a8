"""Repositories of files: discovery, ids, other formats, and the tables that are written."""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom import schema
from leafloom.functions import text as T
from leafloom.sources import markdown
from leafloom.sources.store import Store  # noqa: F401  callers find it here too

#: Suffixes by parser.
MARKDOWN = (".md", ".markdown", ".mdown", ".mkd")
PDF = (".pdf",)
CONVERTED = (".docx", ".pptx", ".xlsx", ".xls", ".html", ".htm", ".csv", ".json", ".xml", ".txt", ".rtf", ".epub", ".msg", ".ipynb", ".rst", ".tsv", ".zip", ".odt")
#: Folders that are never documents.
EXCLUDED = tuple(f"{name}/**" for name in (
    ".git", ".codegraph", ".hypothesis", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", ".tox", ".nox", "venv", "node_modules", "dist", "build", "site", "__pycache__",
))
CONFIG = "loom.toml"


@dataclass(frozen=True)
class RepoConfig:
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = EXCLUDED
    documents_dir: str = "documents"
    primary_doc: str | None = None
    convert: bool = False
    sections_per_doc: int = 1
    preferred_locales: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        schema.within("sections_per_doc", self.sections_per_doc, 1, 8)


def load_config(root: str) -> RepoConfig:
    """The configuration file of a repository; defaults without one."""
    path = Path(root, CONFIG)
    if not path.exists():
        return RepoConfig()
    found = tomllib.loads(path.read_text())
    if unknown := set(found) - set(RepoConfig.__dataclass_fields__):
        raise schema.InvalidConfig(f"unknown settings: {', '.join(sorted(unknown))}")
    return RepoConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def find_root(start: str) -> str | None:
    """The nearest folder at or above ``start`` with a configuration."""
    here = Path(start).resolve()
    return next((str(p) for p in (here, *here.parents) if (p / CONFIG).exists()), None)


def write_config(root: str, config: RepoConfig) -> None:
    show = lambda v: "[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
    Path(root, CONFIG).write_text("".join(f"{k} = {show(getattr(config, k))}\n" for k in RepoConfig.__dataclass_fields__ if getattr(config, k) is not None))


@dataclass(frozen=True)
class Settings:
    """Model settings from the environment (prefix ``LOOM_``); remote models stay off without a URL."""

    llm_url: str = ""
    llm_model: str = ""
    embed_url: str = ""
    embed_model: str = ""
    embed_batch: int = 32
    summary_batch: int = 1
    concurrency: int = 4

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        kind = {k: type(f.default) for k, f in cls.__dataclass_fields__.items()}
        return cls(**{k: kind[k](env[f"LOOM_{k.upper()}"]) for k in kind if f"LOOM_{k.upper()}" in env})


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def excluded(source, patterns: tuple[str, ...]):
    """Any pattern matches the path or its end; ``name/**`` also matches that folder at any depth."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | source.rlike(fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$")) | source.rlike("(?:^|/)" + glob_regex(p)[1:])
        if re.fullmatch(r"[^/*?\[]+/\*\*", p):
            hit = hit | F.array_contains(F.slice(F.split(source, "/"), F.lit(1), F.size(F.split(source, "/")) - 1), p[:-3])
    return hit


def document_ids(found: DataFrame) -> DataFrame:
    """``source`` to ``id``: the path without suffix as one slug; in path order an id in use moves on to the next free number.

    Only a slug that several paths have gives numbers, so only slugs that are one of those and a number can clash with
    them: their paths (nothing else of the rows) are numbered one by one.  All others are numbered by a window over their
    slug; a folder of numbered files has no clash.
    """
    base = T.slug(F.regexp_replace(F.regexp_replace("source", r"\.[^./]+$", ""), "/", "-"), "document")
    rows = found.withColumn("base", base)
    several = rows.groupBy("base").count().where("count > 1").select(F.col("base").alias("root"))
    tail = F.regexp_extract("base", "((?:-[0-9]+)*)$", 1)
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split(tail, "-")) - 1), lambda k: F.array_join(F.slice(F.split("base", "-"), F.lit(1), F.size(F.split("base", "-")) - k), "-"))
    numbered = rows.select("base", tail.alias("tail")).where("tail <> ''").distinct().select("base", F.explode(heads).alias("root")).where("root <> ''")
    clashes = numbered.join(several, "root").groupBy("base").agg(F.min_by("root", F.length("root")).alias("root"))
    clashes = clashes.unionByName(clashes.select(F.col("root").alias("base"), "root").distinct()).groupBy("base").agg(F.min_by("root", F.length("root")).alias("root"))
    rows = rows.join(clashes, "base", "left").withColumn("mixed", F.col("root").isNotNull())
    n = F.row_number().over(Window.partitionBy("base").orderBy("source"))
    plain = rows.where("NOT mixed").withColumn("id", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", F.col("base"), n)))

    def number(group):
        used, after, ids = set(), {}, []
        group = group.sort_values("source")
        for name in group["base"]:
            own, k = name, after.get(name, 2)
            while own in used:
                own, k = f"{name}-{k}", k + 1
            after[name] = k
            used.add(own)
            ids.append(own)
        return group.assign(id=ids)[["source", "id"]]

    clash = rows.where("mixed").select("root", "source", "base").groupBy("root").applyInPandas(number, "source string, id string")
    clash = rows.where("mixed").join(clash, "source")
    return plain.unionByName(clash).drop("base", "root", "mixed")


def select_sources(paths: DataFrame, config: RepoConfig) -> DataFrame:
    """Paths (column ``source``) that are included, not excluded and supported, once each, with ids and ``doc_ord``, which
    grows in path order (a range sort; the numbers may leave gaps)."""
    suffixes = MARKDOWN + PDF + (CONVERTED if config.convert else ())
    keep = F.lit(False)
    for p in config.include:
        keep = keep | F.col("source").rlike(glob_regex(p))
    suffix = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
    found = paths.where(keep & ~excluded(F.col("source"), config.exclude) & suffix.isin(*suffixes)).dropDuplicates(["source"])
    return document_ids(found).orderBy("source").withColumn("doc_ord", F.monotonically_increasing_id())


def discover(spark: SparkSession, root: str, config: RepoConfig) -> DataFrame:
    """``id, source, doc_ord, content, source_file_hash`` of a repository's documents.

    Ids and order are made from the paths alone; the contents of the chosen files are joined last.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = Path(root).resolve().as_posix()
    source = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{re.escape(base)}/", "")
    chosen = select_sources(files.select(source.alias("source")), config)
    return chosen.join(files.select(source.alias("source"), "content"), "source").withColumn("source_file_hash", F.sha2("content", 256))


def parser_of(source: str, convert: bool = True) -> str:
    """The reader of a path by its suffix: markdown, pdf or converted; an unknown suffix is an error."""
    suffix = os.path.splitext(source)[1].lower()
    kinds = {"markdown": MARKDOWN, "pdf": PDF, "converted": CONVERTED if convert else ()}
    for kind, own in kinds.items():
        if suffix in own:
            return kind
    raise schema.InvalidConfig(f"no parser for {suffix!r}: {source}")


def read_markdown(discovered: DataFrame) -> DataFrame:
    """``doc_id, source, text, source_hash`` of the Markdown files."""
    own = discovered.where(F.lower("source").rlike(r"\.(" + "|".join(x[1:] for x in MARKDOWN) + ")$"))
    text = F.decode("content", "UTF-8")
    return own.select(F.col("id").alias("doc_id"), "source", text.alias("text"), F.sha2(text, 256).alias("source_hash"))


def html_to_markdown(html):
    """Headings, paragraphs and list items of HTML as Markdown."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    for n in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}>", "\n\n" + "#" * n + " $1\n\n")
    text = F.regexp_replace(text, r"(?is)<a\b[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", "[$2]($1)")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n- "), r"(?i)</?(p|div|ul|ol|br|tr)\b[^>]*>", "\n\n")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(text, r"\n[ \t]*\n\s*", "\n\n"), r"^\s+|\s+$", "")


def convert(discovered: DataFrame, version: str = "1") -> DataFrame:
    """HTML and plain files as Markdown with a title; the hash covers bytes, converter version and result."""
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.[^./]+)?$", 1)
    text = F.decode("content", "UTF-8")
    body = F.when(F.lower("source").rlike(r"\.html?$"), html_to_markdown(text)).otherwise(text)
    out = discovered.select("id", "source", "content", markdown.with_title(body, stem).alias("text"), body.alias("b")).where(F.col("b").rlike(r"\S"))
    mark = F.sha2(F.concat("content", F.encode(F.concat(F.char(F.lit(0)), F.lit(version), F.char(F.lit(0)), F.col("text")), "UTF-8")), 256)
    return out.select(F.col("id").alias("doc_id"), "source", "text", mark.alias("source_hash"))


def pages_to_sections(pages: DataFrame, toc: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """Pre-extracted page texts (``doc_id, page, text``) to sections.

    ``toc`` (``doc_id, ord, level, title, page``) gives the tree; else ``spans`` (``doc_id, page, ord, size, text``) whose
    size is 1.3 times the median or more give first-level headings; a document with neither is one section.
    """
    by = Window.partitionBy("doc_id").orderBy("page")
    at = F.coalesce(F.sum(F.octet_length("text") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = pages.withColumn("offset", at)
    docs = placed.groupBy("doc_id").agg(F.max(F.col("offset") + F.octet_length("text")).alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
    heads = None
    if toc is not None:
        good = toc.where("trim(title) <> '' AND level IS NOT NULL AND page IS NOT NULL")
        heads = good.join(placed.select("doc_id", "page", "offset"), ["doc_id", "page"]).select("doc_id", "ord", F.greatest(F.lit(1), F.col("level")).alias("level"), F.trim("title").alias("title"), F.col("offset").alias("start"))
    elif spans is not None:
        median = spans.groupBy("doc_id").agg(F.percentile("size", 0.5).alias("median"))
        big = spans.join(median, "doc_id").where("size >= 1.3 * median AND length(trim(text)) BETWEEN 1 AND 200").select("doc_id", "page", F.trim("text").alias("title"))
        found = big.join(placed.withColumnRenamed("text", "page_text"), ["doc_id", "page"]).withColumn("k", F.expr("instr(page_text, title)")).where("k > 0")
        start = (F.col("offset") + F.octet_length(F.expr("substring(page_text, 1, k - 1)"))).cast("int")
        heads = found.select("doc_id", start.alias("ord"), F.lit(1).alias("level"), "title", start.alias("start")).dropDuplicates(["doc_id", "title", "start"])
    if heads is None:
        heads = docs.sparkSession.createDataFrame([], "doc_id string, ord int, level int, title string, start int")
    lone = docs.where("text <> ''").join(heads.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("level"), F.lit("document").alias("title"), F.lit(0).alias("start"))
    heads = heads.unionByName(lone).join(docs, "doc_id")
    heads = heads.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "ord")) - 1).withColumn("body_start", F.col("start"))
    # nesting compares levels as given (their ranks: any six distinct ones); only the stored level is clamped
    rank = F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("doc_id").orderBy("level")))
    heads = heads.withColumn("stored", F.least(F.lit(6), F.col("level"))).withColumn("level", rank)
    rows = markdown.assemble(heads.select("doc_id", "pos", "level", "stored", "title", "start", "body_start", "size"))
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    body = F.decode(F.substring(F.col("raw"), F.col("body_start") + 1, F.greatest(F.lit(0), F.col("body_end") - F.col("body_start"))), "UTF-8")
    return rows.join(raw, "doc_id").select("doc_id", "pos", "section_id", "title", F.col("stored").alias("level"), "parent", "children", "span", "path", body.alias("raw_text"))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` the cache lacks, and the rest with the cached ``text``."""
    return wanted.join(cache.select("key"), "key", "left_anti"), wanted.join(cache.select("key", "text"), "key")


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """A question suite (TOML) as rows of questions; sources are relative to the file."""
    found = tomllib.loads(Path(path).read_text())
    rows = [
        (d["id"], str(Path(path).parent / d["source"]), q["id"], q["question"], list(q.get("expected_anchors", [])), list(q.get("tags", [])), q.get("reference"))
        for d in found["documents"] for q in d["questions"]
    ]
    return spark.createDataFrame(rows, "doc_id string, source string, question_id string, question string, expected_anchors array<string>, tags array<string>, reference string")
