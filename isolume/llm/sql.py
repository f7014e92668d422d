"""DuckDB twins of the queries, where SQL can express them."""

from __future__ import annotations

from isolume.llm.license_scan import DRIFT, NOTICES, PHRASES
from isolume.llm.secret_scan import RULES

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOW.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")

OP1 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT rid, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM docs),
keyed AS (SELECT rid, pos, line, {_KEY} AS key FROM split),
frequent AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT k.rid, k.pos, k.line, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked m JOIN docs d ON m.rid = d.rid GROUP BY d.rid, d.doc_id
"""

OP3 = """
WITH vectors AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.rid AS qid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM vectors q JOIN vectors c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP5 = r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                     md5('mix' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS shuffled FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sizes),
filled AS (SELECT *, source_size * 2 AS full_size, (source_size * 2)::DOUBLE / weight AS full_at FROM weighed),
levels AS (SELECT *, row_number() OVER w AS place, sum(source_size) OVER () AS total,
                  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(full_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                  / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level_here
           FROM filled WINDOW w AS (ORDER BY full_at, source NULLS LAST)),
level AS (SELECT arg_min(level_here, place) AS level FROM levels WHERE level_here <= full_at),
targets AS (SELECT source, source_size, weight, total::BIGINT AS total, CASE WHEN full_at < level THEN full_size::DOUBLE ELSE weight * level END AS target FROM levels, level),
queued AS (SELECT d.*, t.source_size, t.weight, t.target, t.total,
                  sum(d.size) OVER q AS upto, row_number() OVER q AS n
           FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
           WINDOW q AS (PARTITION BY d.source ORDER BY shuffled, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
items AS (SELECT *, (round * source_size + upto)::DOUBLE / weight AS finish FROM queued, (VALUES (0), (1)) r(round)),
placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, round, shuffled, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM items)
SELECT first(doc_id) AS doc_id, first(size) AS size, first(source_size) AS source_size, first(target) AS target,
       sum(greatest(0, least(size, floor(1.5 * total)::BIGINT - ahead)))::BIGINT AS taken
FROM placed GROUP BY source, n
"""


def _license_sql() -> str:
    """Phrases exactly; a notice by the share of its word pairs that can be taken in order on near diagonals."""
    rows = [(p, lab, True) for p, lab in PHRASES.items()] + [(t, lab, False) for lab, t in NOTICES.items()]
    values = []
    for n, (text, label, base) in enumerate(rows):
        words = text.split()
        values += [f"('{a} {b}', {n}, {i}, {len(words) - 1}, '{label}', {str(base).lower()})" for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    low = _LOW.format("coalesce(text, '')")
    return rf"""
WITH templates(tgram, template, tpos, n_grams, label, base) AS (VALUES {", ".join(values)}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
grams AS (SELECT rid, unnest(range(0, len(words) - 1)) AS pos, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM docs),
hits AS (SELECT DISTINCT rid, template, tpos, n_grams, label, base, pos, pos - tpos AS diagonal FROM grams JOIN templates ON gram = tgram),
votes AS (SELECT rid, template, n_grams, label, base, diagonal, count(*) AS n FROM hits GROUP BY ALL),
spans AS (SELECT v.rid, v.template, v.diagonal, any_value(v.label) AS label, any_value(v.n_grams) AS n_grams,
                 list(struct_pack(t := h.tpos::BIGINT, p := h.pos::BIGINT, n := 0::BIGINT) ORDER BY h.tpos, h.pos) AS places
          FROM votes v JOIN hits h ON v.rid = h.rid AND v.template = h.template AND h.diagonal BETWEEN v.diagonal AND v.diagonal + {DRIFT}
          WHERE NOT v.base GROUP BY v.rid, v.template, v.diagonal),
shares AS (SELECT rid, label, list_reduce(places, lambda a, x: CASE WHEN x.t > a.t AND x.p > a.p THEN struct_pack(t := x.t, p := x.p, n := a.n + 1) ELSE a END,
                                          struct_pack(t := -1::BIGINT, p := -1::BIGINT, n := 0::BIGINT)).n / n_grams::DOUBLE AS share FROM spans),
notices AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM shares WHERE share >= 0.7 GROUP BY rid),
phrases AS (SELECT rid, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS labels
            FROM votes WHERE base AND n = n_grams GROUP BY rid)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(p.n_base, 0)::BIGINT AS n_base, p.first_word::BIGINT AS first_word, p.last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(p.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(n.labels, [])))), ','), '') AS labels,
       greatest(CASE WHEN p.n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(n.share, 0.0))::DOUBLE AS score
FROM docs d LEFT JOIN phrases p ON d.rid = p.rid LEFT JOIN notices n ON d.rid = n.rid
"""


def _secret_sql() -> str:
    """Matches and the texts between them give the spans; RE2 is told the letters of either case."""
    union = []
    for order, r in enumerate(RULES):
        pattern = r.pattern
        if pattern.startswith("(?i)"):
            head, rest = pattern[4:].split(")", 1)
            pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + rest
        pattern = pattern.replace("'", "''")
        union.append(f"""
SELECT rid, {order} AS ord, '{r.kind}' AS kind, {r.least} AS least,
       unnest(regexp_extract_all(text, '{pattern}', 0)) AS whole, unnest(regexp_extract_all(text, '{pattern}', {r.group})) AS checked,
       unnest(string_split_regex(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}', 0))]) AS gap,
       unnest(range(1, len(regexp_extract_all(text, '{pattern}', 0)) + 1)) AS i
FROM docs WHERE regexp_matches(text, '{pattern}')""")
    kinds = [r.kind for r in RULES if r.base]
    counts = ", ".join(f"count(*) FILTER (WHERE ord = {n}) AS n_{k}" for n, k in enumerate(kinds))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(union)}),
ends AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY rid, ord ORDER BY i) AS stop FROM found),
spans AS (SELECT rid, ord, stop - length(whole) AS start, kind || ':' || (stop - length(whole))::BIGINT || ':' || stop::BIGINT AS span FROM ends WHERE length(checked) >= least),
lists AS (SELECT rid, {counts}, string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE ord < {len(kinds)}) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans
          FROM spans GROUP BY rid)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN lists l ON d.rid = l.rid
"""


ORACLE_SQL = {
    "op1_line_dedup": OP1,
    "op3_exact_topk": OP3,
    "op5_source_mixing": OP5,
    "op6_license_scan": _license_sql(),
    "op10_secret_scan": _secret_sql(),
}
