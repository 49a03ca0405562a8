"""A search query parsed on the driver: a few terms with their variants and weights."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Word lists and limits of the query language.
STOP_WORDS = "a an and are for how is of or the to what where".split()
GENERIC_WORDS = "about do does from how in into it on using what when where which work works with".split()
PHRASE_STOPS = "a an and are for how in is of or the to what where with".split()
WEAK_VERBS = "run runs test tests testing use using write writes written".split()
HISTORY_DOCS = "changelog changes history release releases migration migrations".split()
HISTORY_QUERIES = "breaking change changes changelog deprecated deprecation history migration migrations release released releases upgrade version versions".split()
LOCALES = "ar de en es fa fr hi id it ja ko nl pl pt ru tr uk vi zh".split()
FAMILIES = {
    ("eval",): "eval evals evaluate evaluates evaluated evaluating evaluation evaluations evaluator evaluators",
    ("depend", "deps"): "dep deps depend depends dependency dependencies dependent dependents",
    ("inject",): "inject injects injected injecting injection injections",
    ("config",): "config configs configure configured configuration",
    ("auth",): "auth authenticate authentication authorization",
    ("install",): "install installs installed installer installers installing installation",
    ("login",): "login logins logged logging",
    ("publish",): "publish published publishes publishing",
    ("store",): "store stored stores storage",
    ("stream",): "stream streams streamed streaming",
}
MOST_TERMS, WEAK_WEIGHT = 40, 0.35


def query_terms(query: str) -> list[str]:
    """Words of three letters or more that are no stop words, then runs of CJK and their shorter pieces; in order, once."""
    low = query.lower()
    found = [w for w in re.findall(r"[a-z0-9_][a-z0-9_-]*", low) if len(w) > 2 and w not in STOP_WORDS]
    for run in re.findall("[㐀-鿿]+", low):
        found += [run] * (len(run) > 1)
        found += [run[k : k + n] for n in range(min(6, len(run)), 1, -1) for k in range(len(run) - n + 1)]
    return list(dict.fromkeys(found))[:MOST_TERMS]


def compact(word: str) -> bool:
    """Short, or with a digit or underscore: looks like an identifier."""
    return len(word) <= 4 or bool(re.search(r"[\d_]", word))


def search_terms(query: str) -> list[str]:
    """Terms of a search over documents.  Short words come back at the end, even stop words, unless they are generic."""
    kept = [t for t in query_terms(query) if t not in GENERIC_WORDS]
    tail = [w for w in re.findall(r"[a-z0-9_][a-z0-9_-]*", query.lower()) if len(w) > 1 and w not in GENERIC_WORDS and compact(w)]
    return list(dict.fromkeys(kept + tail))


def variants(term: str) -> list[str]:
    """Plural and singular forms and the family of a term, longest first."""
    found = {term}
    if term[-1:] == "s":
        found |= {term[:-1]} if len(term) > 3 else set()
        found |= {term[:-3] + "y"} if term.endswith("ies") and len(term) > 4 else set()
    elif len(term) > 2:
        found.add(term + "s")
    if term[-1:] == "y" and len(term) > 3:
        found.add(term[:-1] + "ies")
    for stems, family in FAMILIES.items():
        if term.startswith(stems):
            found.update(family.split())
    return sorted(found, key=lambda v: (len(v), v), reverse=True)


def command_phrases(query: str) -> list[str]:
    """Runs of four to two words without stop words, with at least one that looks like an identifier."""
    tokens = re.findall(r"[a-z0-9_][a-z0-9_-]*", query.lower())
    runs = [tokens[k : k + n] for n in range(min(4, len(tokens)), 1, -1) for k in range(len(tokens) - n + 1)]
    return list(dict.fromkeys(" ".join(r) for r in runs if not set(r) & set(PHRASE_STOPS) and any(map(compact, r))))


def phrase_weight(phrase: str) -> float:
    tokens = phrase.split()
    return min(8.0, 2.0 + min(4, len(tokens)) + 2.0 * any(map(compact, tokens)))


def query_locale(query: str) -> str | None:
    if re.search("[぀-ヿ㐀-鿿가-힯]", query):
        return None
    return "en" if re.search("[A-Za-z]", query) else None


def preferred_locales(configured: list[str], query: str) -> list[str]:
    """The configured languages that are known; without a configuration that of the query."""
    named = [c.lower().replace("_", "-").split("-")[0] for c in configured if c.strip()]
    if named:
        return [c for c in named if c in LOCALES]
    found = query_locale(query)
    return [found] if found else []


@dataclass(frozen=True)
class Query:
    """Terms in order, each with variants and a weight, and phrases."""

    terms: list[str]
    variants: dict[str, list[str]]
    weights: dict[str, float]
    phrases: list[str]
    locales: list[str]
    wants_history: bool


def parse(query: str, locales: tuple[str, ...] = ()) -> Query:
    """The query before corpus weights."""
    terms = search_terms(query)
    forms = {t: variants(t) for t in terms}
    history = any(v in HISTORY_QUERIES for t in terms for v in [t, *forms[t]] if " " not in v)
    weights = {t: WEAK_WEIGHT if t in WEAK_VERBS else 1.0 for t in terms}
    return Query(terms, forms, weights, command_phrases(query), preferred_locales(list(locales), query), history)
