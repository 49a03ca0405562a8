"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from leafloom.llm.decontaminate import op3_decontamination
from leafloom.llm.near_dedup import op6_near_dedup
from leafloom.llm.packing import op9_best_fit_packing
from leafloom.llm.passages import op5_repeated_passages
from leafloom.llm.piece_codec import op11_piece_codec
from leafloom.llm.quality_rules import op10_quality_rules
from leafloom.llm.secret_scan import op2_secret_scan
from leafloom.llm.sharding import op8_sharding
from leafloom.llm.source_divergence import op13_source_divergence
from leafloom.llm.token_counts import op7_token_counts
from leafloom.llm.token_output import op1_token_output
from leafloom.llm.toxicity import op4_toxicity
from leafloom.llm.whitening import op12_whitening

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_near_dedup": op6_near_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_piece_codec": op11_piece_codec,
    "op12_whitening": op12_whitening,
    "op13_source_divergence": op13_source_divergence,
}

WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op6_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS W FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(W) = 0 THEN [] WHEN len(W) < 3 THEN [array_to_string(W, ' ')] ELSE [array_to_string(W[i + 1:i + 3], ' ') FOR i IN range(len(W) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n k ON k.doc_id = x JOIN n l ON l.doc_id = y WHERE 100 * c >= 85 * (k.n + l.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op10_quality_rules": f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS W FROM documents),
g AS (SELECT doc_id, i, array_to_string(W[i + 1:i + 8], ' ') AS g FROM w, UNNEST(range(greatest(len(W) - 7, 0))) u(i)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, UNNEST(range(8)) u(k) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORDS}') GROUP BY 1),
m AS (SELECT doc_id, len(W) AS n_words, length(array_to_string(W, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, CAST(n_words < 20 AS INT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS INT) + 4 * CAST(2 * n_dup_lines > n_lines AS INT) + 8 * CAST(10 * n_symbols > n_words AS INT)
  + 16 * CAST(word_chars < 2 * n_words AS INT) + 32 * CAST(word_chars > 14 * n_words AS INT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed, n_lines,
  CASE WHEN bit_count(failed) = 1 THEN failed ELSE 0 END AS sole_failure, count(*) OVER (PARTITION BY failed) AS n_alike FROM b""",
    "op13_source_divergence": rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS T FROM documents),
o AS (SELECT lang, source, list_distinct(T) AS D, T FROM d),
v AS (SELECT lang, term FROM (SELECT lang, unnest(D) AS term FROM o) GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(T) AS term FROM o) JOIN v USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, count(*) AS size FROM v GROUP BY 1),
g AS (SELECT lang, source, coalesce(size, 0) AS size, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) USING (lang, source)),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (g.total + 2 * g.size) AS BIGINT) AS p FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(n) + 2) // (any_value(whole) + 2 * any_value(size)) AS BIGINT) AS q FROM c JOIN s USING (lang) JOIN (SELECT lang, sum(n) AS whole FROM c GROUP BY 1) USING (lang) GROUP BY 1, 2),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10""",
}
