"""DuckDB SQL for the opN queries that SQL can express."""

from __future__ import annotations

from kerbline.llm import chat_format as c
from kerbline.llm import line_dedup as d
from kerbline.llm import quality_rules as q

_RATIO = {
    "symbol_share": "n_symbols / nullif(word_chars, 0)",
    "capital_share": "n_capitals / nullif(word_chars, 0)",
    "shout_share": "n_shouts / nullif(word_chars, 0)",
    "word_length": "nullif(word_chars, 0) / nullif(n_words, 0)",
    "duplicate_line_share": "n_dup_lines / nullif(n_lines, 0)",
    "repeat_share": "n_repeat_words / nullif(n_words, 0)",
}


def quality_ctes(docs: str = "documents") -> str:
    """CTEs ending in qr_verdict, one row per document."""
    fence = lambda x: f"quantile_disc({x}, 0.75) + {q.FENCE} * greatest(quantile_disc({x}, 0.75) - quantile_disc({x}, 0.25), {q.LEAST_SPREAD[x]})"
    level = lambda name, by: f"{name} AS (SELECT {by + ', ' if by else ''}count(symbol_share) AS n, {', '.join(f'{fence(x)} AS {x}' for x in _RATIO)} FROM qr_ratio {'GROUP BY ' + by if by else ''})"
    pick = ", ".join(f"CASE WHEN o.n >= {q.LEAST_GROUP} THEN o.{x} WHEN p.n >= {q.LEAST_GROUP} THEN p.{x} ELSE r.{x} END AS f_{x}" for x in _RATIO)
    return rf"""
qr_doc AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
qr_window AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM qr_doc WHERE len(w) >= 3),
qr_text AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM qr_window),
qr_twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM qr_text),
qr_covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM qr_twice WHERE c > 1) GROUP BY doc_id),
qr_line AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT l) AS n_distinct FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM qr_doc) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
qr_count AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_shouts, coalesce(n_lines, 0) AS n_lines
  FROM qr_doc d LEFT JOIN qr_covered c USING (doc_id) LEFT JOIN qr_line l USING (doc_id)),
qr_ratio AS (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS {x}' for x, e in _RATIO.items())} FROM qr_count),
{level('qr_own', 'lang, source')}, {level('qr_parent', 'lang')}, {level('qr_root', '')},
qr_fence AS (SELECT o.lang, o.source, {pick} FROM qr_own o JOIN qr_parent p ON o.lang IS NOT DISTINCT FROM p.lang CROSS JOIN qr_root r),
qr_failed AS (SELECT q.*, n_words < {q.BASE_LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM qr_ratio q),
qr_verdict AS (SELECT q.*, NOT base_failed AND {' AND '.join(f'coalesce({x} <= f_{x}, true)' for x in _RATIO)} AS kept FROM qr_failed q JOIN qr_fence f ON q.lang IS NOT DISTINCT FROM f.lang AND q.source IS NOT DISTINCT FROM f.source)"""


_WORD5 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = lambda t: f"translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontaminate_ctes(docs: str = "documents") -> str:
    """CTEs ending in wm_report, one row per document."""
    return f"""
wm_doc AS (SELECT doc_id, regexp_extract_all({_LOWER('text')}, '{_WORD5}') AS w FROM {docs}),
wm_item AS (SELECT item_id, regexp_extract_all({_LOWER('text')}, '{_WORD5}') AS w FROM benchmark),
wm_start AS (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM wm_item WHERE len(w) > 0),
wm_pattern AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM wm_start),
wm_length AS (SELECT DISTINCT m FROM wm_pattern),
wm_at AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM wm_doc, wm_length WHERE len(w) >= m),
wm_hit AS (SELECT a.doc_id, a.i, a.m, p.item_id FROM (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM wm_at) a JOIN wm_pattern p ON a.m = p.m AND a.s = p.s),
wm_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM wm_hit) GROUP BY doc_id),
wm_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM wm_hit GROUP BY doc_id),
wm_report AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM wm_doc d LEFT JOIN wm_words USING (doc_id) LEFT JOIN wm_items USING (doc_id))"""


def chat_sql() -> str:
    """The windows' lengths follow from the same prefix sums; the digests come straight from the turns."""
    esc = lambda t: f"replace(replace({t}, '&', '&amp;'), '<', '&lt;')"
    share = int(c.BUDGET * c.HISTORY_SHARE)
    leads = ", ".join(f"lead(win, {k}) OVER o AS l{k}" for k in range(1, c.HISTORY + 1))
    again = " + ".join(f"CASE WHEN l{k} <> win{''.join(f' AND l{k} IS DISTINCT FROM l{j}' for j in range(1, k))} THEN 1 ELSE 0 END" for k in range(1, c.HISTORY + 1))
    return f"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
b AS (SELECT *, row_number() OVER o AS n, CAST(ceil(strlen({esc('text')}) / {c.BYTES_PER_TOKEN}.0) AS BIGINT) + {c.TURN_TOKENS} AS tokens, length({esc('role')}) + length({esc('text')}) + {len('<|turn|><|text|><|end|>')} AS chars FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT conv_id, tokens AS s_tokens, chars AS s_chars FROM b WHERE n = 1 AND role = 'system'),
d0 AS (SELECT b.*, s_chars, greatest({c.BUDGET} - coalesce(s_tokens, 0), 0) AS remaining FROM b LEFT JOIN s USING (conv_id)),
d1 AS (SELECT *, least({share}, remaining // 4) AS share, greatest(remaining - least({share}, remaining // 4), 1) AS room FROM d0),
d AS (SELECT *, room // 2 AS half, room - coalesce(max(CASE WHEN tokens <= room // 2 THEN tokens END) OVER (PARTITION BY conv_id), 0) AS width FROM d1),
e AS (SELECT *, sum(tokens) OVER r AS prefix, sum(CAST(tokens > half AS INT)) OVER r AS longs FROM d WINDOW r AS (PARTITION BY conv_id ORDER BY n)),
f AS (SELECT *, ((prefix - 1) // width) || ' ' || longs || ' ' || (tokens > half) AS cell FROM e),
g AS (SELECT *, CAST(cell IS DISTINCT FROM lag(cell) OVER (PARTITION BY conv_id ORDER BY n) AS INT) AS fresh FROM f),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY n) - 1 AS win FROM g),
i AS (SELECT *, {leads} FROM h WINDOW o AS (PARTITION BY conv_id ORDER BY n)),
j AS (SELECT *, CASE WHEN tokens * {c.HISTORY} <= share AND NOT (n = 1 AND role = 'system') THEN {again} ELSE 0 END AS repeats FROM i)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * (1 + repeats)) + max(win) * coalesce(max(s_chars), 0) AS BIGINT) AS formatted_chars FROM j GROUP BY conv_id"""


def line_ctes(docs: str = "documents") -> str:
    """CTEs ending in ld_text (doc_id, text, n_exact, n_near), for documents with distinct ids."""
    return rf"""
ld_all AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {docs}),
ld_line AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS eligible FROM ld_all),
ld_first AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM ld_line WHERE eligible GROUP BY line),
ld_near AS (SELECT DISTINCT b.line FROM ld_first a JOIN ld_first b ON b.n BETWEEN a.n - {d.EDITS} AND a.n + {d.EDITS} AND a.n >= {d.LEAST_CHARS} AND b.n >= {d.LEAST_CHARS}
  AND a.first < b.first AND levenshtein(a.line, b.line) <= {d.EDITS}),
ld_verdict AS (SELECT l.*, coalesce(eligible AND (doc_id, pos) <> f.first, false) AS exact, coalesce(eligible AND l.line IN (SELECT line FROM ld_near), false) AS near FROM ld_line l LEFT JOIN ld_first f ON l.line = f.line),
ld_kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT exact AND NOT near) AS kept, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near FROM ld_verdict GROUP BY doc_id),
ld_text AS (SELECT d.* EXCLUDE (text), CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near FROM {docs} d LEFT JOIN ld_kept USING (doc_id))"""


ORACLES: dict[str, str] = {
    "op1_chat_format": chat_sql(),
    "op5_decontaminate": f"WITH {decontaminate_ctes()} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_hit AS BIGINT) AS n_hit, CAST(n_items AS BIGINT) AS n_items, items_sha256, contaminated FROM wm_report",
    "op7_quality_rules": f"""WITH {quality_ctes()}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM qr_verdict""",
    "op9_line_dedup": f"""WITH {line_ctes()}
SELECT doc_id, n_exact, n_near, length(coalesce(text, '')) AS kept_chars, sha256(coalesce(text, '')) AS kept_sha256 FROM ld_text""",
}
