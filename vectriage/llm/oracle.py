"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP13 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, {WHITE_SQL}), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id < r.top AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total, coalesce(max(v.v), 0)::HUGEINT AS v
        FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source),
p AS (SELECT tot.lang, tot.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (tot.total + tot.v) AS p
      FROM tot JOIN kept k ON k.lang = tot.lang LEFT JOIN c ON c.lang = tot.lang AND c.source = tot.source AND c.term = k.term),
ql AS (SELECT lang, sum(total) AS total, max(v) AS v FROM tot GROUP BY lang),
q AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // (any_value(ql.total) + any_value(ql.v)) AS q FROM c JOIN ql ON ql.lang = c.lang GROUP BY c.lang, c.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
                               WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
         FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) AS value
         FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 200"""

WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORD}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS own FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY own) AS class_id FROM sets),
one AS (SELECT s.* FROM s JOIN c ON c.doc_id = s.doc_id AND c.class_id = s.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM one a JOIN one b ON b.g = a.g AND b.doc_id <> a.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.both >= 85 * (x.n + y.n - p.both)),
reach AS (SELECT DISTINCT class_id AS a, class_id AS b FROM c UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
       coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = c.class_id
     LEFT JOIN links k ON k.a = c.class_id"""

CONTROL = "<|im_end|><|im_start|>assistant ok"
OP5 = f"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
f AS (SELECT *, '<|im_start|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\\\*)\\|', '<\\\\\\1|', 'g') || chr(10)
             || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '<|im_end|>' || chr(10) AS segment FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, segment) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(segment)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM f GROUP BY conv_id"""


def _rules_sql(risk: float = 0.04, delta: float = 0.05) -> str:
    """Base metrics and the verdict of the certified cutoffs, the binomial sums by logarithms of the gamma function."""
    from vectriage.llm.quality_rules import CUTOFFS

    tests = [(rule, c) for rule, values in CUTOFFS.items() for c in values]
    rate = risk / len(CUTOFFS)
    listed = ", ".join(f"('{rule}', {c}::DOUBLE)" for rule, c in tests)
    values = ", ".join(f"('{rule}', {rule})" for rule in CUTOFFS)
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
r AS (SELECT doc_id, sum(least(3, coalesce(following - i, 3))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM g WHERE times > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_share, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share,
             n_dup_lines::DOUBLE / greatest(n_words, 1) AS dup_line_share, word_chars::DOUBLE / greatest(n_words, 1) AS mean_word FROM m),
v AS (SELECT f.doc_id, f.lang, f.base_failed, u.rule, u.value FROM f, LATERAL (VALUES {values}) u(rule, value)),
good AS (SELECT v.* FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
t AS (SELECT g.lang, x.rule, x.cutoff, count(*) AS n, count_if(g.value > x.cutoff) AS k
      FROM good g JOIN (VALUES {listed}) x(rule, cutoff) ON x.rule = g.rule GROUP BY g.lang, x.rule, x.cutoff),
strata AS (SELECT count(*) AS strata FROM (SELECT DISTINCT lang FROM good)),
chance AS (SELECT lang, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate}))) AS p
           FROM (SELECT *, unnest(range(0, CAST(k + 1 AS BIGINT))) AS i FROM t WHERE k < n * {rate}) GROUP BY lang, rule, cutoff),
cut AS (SELECT lang, rule, min(cutoff) AS cutoff FROM chance, strata WHERE p <= {delta} / ({len(tests)} * strata) GROUP BY lang, rule),
over AS (SELECT DISTINCT v.doc_id FROM v JOIN cut ON cut.rule = v.rule AND cut.lang IS NOT DISTINCT FROM v.lang WHERE v.value > cut.cutoff)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.doc_id IS NULL AS kept
FROM f LEFT JOIN over o ON o.doc_id = f.doc_id"""


def _spans_sql(width: int) -> str:
    """``spans(doc_id, a, b)``: maximal runs, from 1, b exclusive, covered by windows ``win(doc_id, i, key)`` whose key also starts earlier."""
    return f"""
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM win) WHERE nth > 1),
marked AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
           FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {width} THEN 0 ELSE 1 END AS fresh FROM again)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {width} AS b FROM marked GROUP BY doc_id, run),
edges AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY doc_id)"""


OP9 = f"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS key FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)),
{_spans_sql(100)},
kept AS (SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN d.h ELSE array_to_string(list_transform(range(0, e.n + 1), lambda k:
                substr(d.h, 2 * (CASE WHEN k = 0 THEN 1 ELSE e.ends[k] END) - 1,
                       2 * ((CASE WHEN k = e.n THEN d.n + 1 ELSE e.starts[k + 1] END) - (CASE WHEN k = 0 THEN 1 ELSE e.ends[k] END)))), '') END AS h
         FROM d LEFT JOIN edges e ON e.doc_id = d.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(e.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(e.n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN edges e ON e.doc_id = d.doc_id"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
{_spans_sql(20)}
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(e.gone, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN e.doc_id IS NULL THEN array_to_string(d.words, ' ') ELSE array_to_string(flatten(list_transform(range(0, e.n + 1), lambda k:
              d.words[(CASE WHEN k = 0 THEN 1 ELSE e.ends[k] END):((CASE WHEN k = e.n THEN len(d.words) + 1 ELSE e.starts[k + 1] END) - 1)])), ' ') END) AS kept_sha256
FROM d LEFT JOIN edges e ON e.doc_id = d.doc_id"""

ORACLE = {
    "op1_ngram_jaccard_join": OP1, "op5_chat_formatting": OP5, "op6_quality_rules": _rules_sql(), "op9_suffix_array_dedup": OP9,
    "op10_substring_dedup": OP10, "op11_source_audit": OP11, "op13_line_dedup": OP13,
}
