"""The pN_ queries with their production parameters, and SQL for those it can express."""

from __future__ import annotations

from mnemora.llm import bpe, dedupe, mainbody, mixing, neardup, readlevel, residue, sitelines, topn
from mnemora.runtime import table as t


def queries() -> dict:
    return {
        "p1_found": lambda s, d: residue.found(t(s, d, "documents")),
        "p2_found": lambda s, d: neardup.found(t(s, d, "documents")),
        "p2_links": lambda s, d: neardup.links(t(s, d, "documents")),
        "p2_classes": lambda s, d: neardup.classes(t(s, d, "documents")),
        "p3_found": lambda s, d: dedupe.found(t(s, d, "links"), t(s, d, "histories")),
        "p3_counts": lambda s, d: dedupe.counts(t(s, d, "links"), t(s, d, "histories")),
        "p4_found": lambda s, d: mainbody.found(t(s, d, "captures")),
        "p5_found": lambda s, d: topn.top_n(t(s, d, "history_links"), "history_id", "count", "link_id", 5).select("history_id", "link_id"),
        "p6_found": lambda s, d: sitelines.found(t(s, d, "documents")),
        "p6_clean": lambda s, d: sitelines.clean(t(s, d, "documents")),
        "p7_ids": lambda s, d: bpe.ids(t(s, d, "documents")),
        "p8_selection": lambda s, d: mixing.selection(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.shares(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_found": lambda s, d: readlevel.found(t(s, d, "documents"), t(s, d, "reading_labels")),
        "p9_levels": lambda s, d: readlevel.levels(t(s, d, "documents"), t(s, d, "reading_labels")),
    }


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_P2_PAIRS = """
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) g FROM w WHERE len(w) >= 40),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
r AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 2 * c >= p.n + q.n - c)"""
_P2 = f"WITH w AS (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL), {_P2_PAIRS} SELECT x AS doc_id_a, y AS doc_id_b FROM r"
_P2_CLASSES = f"""WITH a AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_WORDS} END w FROM documents),
k AS (SELECT doc_id, w, CASE WHEN len(w) >= 40 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END class_id FROM a),
w AS (SELECT doc_id, w FROM k WHERE doc_id = class_id AND w IS NOT NULL), {_P2_PAIRS}"""

_DROP = r"[^\p{L}\p{N}]+"
_FIELD = "regexp_matches(x, '^[-+]?(url:|title:|text:)')"
_TERM = r"(CASE WHEN x LIKE '-%' THEN '-' ELSE '' END || regexp_replace(x, '[^\p{L}\p{N}*]+', '', 'g'))"
_P3 = rf"""
WITH l AS (SELECT 'links' table_name, id, lower(upper(url)) u FROM links WHERE url IS NOT NULL),
lk AS (SELECT table_name, id, 'l' || regexp_replace(split_part(u, '?', 1), '{_DROP}', '', 'g') || chr(1) || array_to_string(list_sort(list_filter(list_transform(string_split(CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) ELSE '' END, '&'), lambda x: regexp_replace(x, '{_DROP}', '', 'g')), lambda x: x <> '')), chr(2)) k FROM l),
h AS (SELECT 'histories' table_name, id, list_filter(string_split_regex(lower(upper(query)), '[\s\x{{a0}}\x{{85}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) t FROM histories WHERE query IS NOT NULL),
hk AS (SELECT table_name, id, 'h' || array_to_string(list_transform(list_filter(t, lambda x: NOT {_FIELD}), lambda x: {_TERM}), chr(2)) || chr(1) || array_to_string(list_sort(list_transform(list_filter(t, lambda x: {_FIELD}), lambda x: {_TERM})), chr(2)) k FROM h),
r AS (SELECT table_name, id, min(id) OVER (PARTITION BY table_name, k) keep_id FROM (SELECT * FROM lk UNION ALL SELECT * FROM hk))"""
_P6 = r"""
WITH l AS (SELECT doc_id, source, captured_at, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no FROM documents),
m AS (SELECT doc_id, source, line_no, trim(regexp_replace(lower(x), '[\s\x{a0}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g')) y FROM l),
g AS (SELECT source, y FROM m WHERE y <> '' GROUP BY source, y HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, line_no::INT AS line_no FROM m JOIN g USING (source, y)"""

_P6_CLEAN = r"""
WITH d AS (SELECT source, count(DISTINCT captured_at::DATE) AS nd FROM documents WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT doc_id, o.source, CASE WHEN nd >= 2 THEN captured_at::DATE END dy, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no FROM documents o LEFT JOIN d USING (source) WHERE text IS NOT NULL),
m AS (SELECT *, trim(regexp_replace(lower(x), '[\s\x{a0}\x{85}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g')) y FROM l),
k AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY line_no) c FROM m WHERE y <> '' GROUP BY doc_id),
p AS (SELECT source, y, c, count(DISTINCT doc_id) n, min(dy) dy FROM m JOIN k USING (doc_id) WHERE y <> '' GROUP BY source, y, c),
g AS (SELECT source, y FROM p WHERE source IS NOT NULL GROUP BY source, y HAVING sum(n) >= 5 AND count(*) >= 5 AND count(DISTINCT dy) <> 1),
r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY line_no) t FROM m LEFT JOIN g USING (source, y) WHERE g.y IS NULL GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text FROM documents LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p2_links": _P2_CLASSES + " SELECT x AS class_a, y AS class_b FROM r",
        "p2_classes": _P2_CLASSES + ", l AS (SELECT z, count(*) n FROM (SELECT x z FROM r UNION ALL SELECT y FROM r) GROUP BY z) SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM k LEFT JOIN l ON z = class_id",
        "p3_found": _P3 + " SELECT table_name, keep_id, id AS copy_id FROM r WHERE id <> keep_id",
        "p3_counts": _P3 + " SELECT table_name, keep_id, count(DISTINCT id) AS n_copies FROM r GROUP BY ALL",
        "p5_found": 'SELECT history_id, link_id FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY "count" DESC, link_id) rn FROM (SELECT DISTINCT history_id, link_id, "count" FROM history_links WHERE history_id IS NOT NULL AND "count" IS NOT NULL AND link_id IS NOT NULL)) WHERE rn <= 5',
        "p6_found": _P6,
        "p6_clean": _P6_CLEAN,
    }
