"""Table schemas and errors."""

from __future__ import annotations

FORMAT_VERSION = 1
SPAN = "struct<start:int,end:int>"
SECTIONS = f"doc_id string, pos int, section_id string, title string, level int, parent string, children array<string>, span {SPAN}, path array<string>, raw_text string"
SUMMARIES = "doc_id string, section_id string, gist string, synopsis string, digest string, model string, section_hash string, generated_at timestamp"
ENTITY_HITS = f"doc_id string, hit_ord int, section_id string, canonical string, surface_form string, kind string, span {SPAN}"
XREFS = f"doc_id string, src string, dst string, kind string, confidence double, span {SPAN}"
VECTORS = "doc_id string, section_id string, dim int, vector array<float>"
STATUS = "id string, source string, doc_dir string, state string, section_count int, source_hash string, indexed_hash string, source_file_hash string, indexed_source_file_hash string, indexed_at timestamp, error string"
MANIFEST = "doc_id string, indexed_hash string, indexed_source_file_hash string, section_count int, indexed_at timestamp, summarizer string, embedder string, parser string, entity_extractor string, xref_extractor string"
ENTITY_KINDS = ("term", "code", "proper", "defined")
FAILURES = "doc_id string, stage string, error string"
XREF_KINDS = ("link", "textual", "entity")
STATES = ("indexed", "stale", "missing", "error", "orphaned")


class LoomError(Exception):
    """Base of all errors; ``code`` names the kind."""

    code = "INTERNAL"


class ParseFailed(LoomError):
    code = "PARSE_FAILED"


class BuildFailed(LoomError):
    code = "INDEX_BUILD_FAILED"


class NotFound(LoomError):
    code = "NOT_FOUND"


class Stale(LoomError):
    code = "INDEX_STALE"


class Conflict(LoomError):
    """Another writer was faster."""

    code = "CONFLICT"


class InvalidConfig(LoomError):
    code = "INVALID_CONFIG"


class InvalidInput(LoomError):
    code = "INVALID_INPUT"


def within(name: str, value: int, low: int, high: int) -> int:
    """An argument inside its range."""
    if not low <= value <= high:
        raise InvalidInput(f"{name} must be in [{low}, {high}]; got {value}")
    return value
