"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from . import secrets

WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY 1),
r AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight, source_size * 20 / [5, 2, 1][place % 3 + 1]::DOUBLE AS ratio FROM s),
f AS (SELECT *, coalesce(sum(2 * source_size) OVER p, 0)::DOUBLE AS full_, coalesce(sum(weight) OVER p, 0)::DOUBLE AS spent, sum(source_size) OVER ()::DOUBLE AS all_, sum(weight) OVER ()::DOUBLE AS weights
  FROM r WINDOW p AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (all_ * 1.5::DOUBLE - full_) / (weights - spent) AS level FROM f),
h AS (SELECT *, level * weight >= source_size * 2 AS is_full FROM g),
t AS (SELECT source, place, source_size, CASE WHEN is_full THEN source_size * 2::DOUBLE ELSE (SELECT level FROM h WHERE NOT is_full ORDER BY ratio, place LIMIT 1) * weight END AS target FROM h),
a AS (SELECT *, coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(target) OVER () AS total FROM t),
arcs AS (SELECT *, floor(low / total * 4294967296)::BIGINT AS from_, least(floor((low + target) / total * 4294967296)::BIGINT, 4294967296) AS to_ FROM a),
slots AS (SELECT i, (i % 4294967296) * 1640531527 % 4294967296 AS point FROM range((SELECT ceil(round(max(total)) / 256)::BIGINT FROM arcs)) x(i)),
met AS (SELECT i, place FROM slots JOIN arcs ON point >= from_ AND point < to_),
dealt AS (SELECT i, place FROM met UNION ALL SELECT (SELECT count(*) FROM slots) + place, place FROM t WHERE round(target) > 0 AND place NOT IN (SELECT place FROM met)),
ranked AS (SELECT i, place, row_number() OVER (PARTITION BY place ORDER BY i) - 1 AS rank, count(*) OVER (PARTITION BY place) AS n, round(target)::BIGINT AS goal FROM dealt JOIN t USING (place)),
blocks AS (SELECT i, place, sum(goal // n + (rank < goal % n)::INT) OVER (PARTITION BY place ORDER BY rank) AS high, high - (goal // n + (rank < goal % n)::INT) AS low FROM ranked),
laid AS (SELECT doc_id, size, place, source_size, target, (coalesce(sum(size) OVER (PARTITION BY place ORDER BY md5(concat_ws('|', '11', doc_id::VARCHAR, size::VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS at_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT place, at_, p, p * source_size + at_ AS begin_, p * source_size + at_ + size AS end_ FROM laid, range(2) y(p) WHERE size > 0),
got AS (SELECT at_, place, sum(least(end_, high) - greatest(begin_, low))::BIGINT AS taken, coalesce(sum(least(end_, high) - greatest(begin_, low)) FILTER (p = 0), 0)::BIGINT AS first_pass, min(i)::BIGINT AS first_slot
  FROM passes JOIN blocks USING (place) WHERE begin_ < high AND low < end_ GROUP BY 1, 2)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(g.taken, 0) AS taken, coalesce(g.first_pass, 0) AS first_pass, coalesce(g.taken - g.first_pass, 0) AS second_pass, g.first_slot
FROM laid l LEFT JOIN got g ON l.place = g.place AND l.at_ = g.at_ AND l.size > 0
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, no, ls[no] AS line, regexp_extract_all(ls[no], '{WORDS}') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS no FROM d)),
p AS (SELECT doc_id, no, line, len(w) AS n, array_to_string(w, ' ') AS plain, w FROM l),
o AS (SELECT plain, min((doc_id, no)) AS at_, any_value(w) AS w, any_value(n) AS n FROM p WHERE n > 0 GROUP BY 1),
k AS (SELECT plain, at_, w, n, row_number() OVER (ORDER BY at_) AS rank FROM o),
c AS (SELECT rank, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT rank, w, unnest(range(1, n + 1)) AS i FROM k WHERE n >= 5)),
replaced AS (SELECT DISTINCT rank FROM (SELECT rank, min(rank) OVER (PARTITION BY v, i) AS first FROM c) WHERE first < rank),
cut AS (SELECT v, min(rank) AS first FROM c GROUP BY 1),
longer AS (SELECT c.rank FROM c JOIN k ON c.v = k.plain AND k.n >= 5 WHERE k.rank < c.rank UNION SELECT k.rank FROM k JOIN cut ON cut.v = k.plain WHERE k.n >= 5 AND cut.first < k.rank),
near AS (SELECT plain FROM k WHERE rank IN (SELECT rank FROM replaced UNION SELECT rank FROM longer)),
judged AS (SELECT p.doc_id, p.no, p.line, p.n > 0 AND ((p.doc_id, p.no) <> k.at_ OR near.plain IS NOT NULL) AS goes FROM p LEFT JOIN k ON p.plain = k.plain LEFT JOIN near ON near.plain = p.plain)
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(string_agg(j.line, chr(10) ORDER BY j.no) FILTER (NOT coalesce(goes, false)), '') END AS text, count(j.no) AS n_lines, count(j.no) FILTER (goes) AS n_removed
FROM d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    """A list of (start, kind, end) from the texts between the matches and the matches.

    The engine has no lookbehind: what must not be a letter or digit is matched in a group of its own, whose length moves the start. No
    match can begin right behind another one's last character, which is followed by none of its class, so nothing is lost.
    """
    lead = secrets.LEAD in pattern
    if lead:
        pattern = "(^|[^A-Za-z0-9])(?i)" + pattern.removeprefix("(?i)").removeprefix(secrets.LEAD)
    pattern, group = pattern.replace("'", "''"), group + lead
    hits, gaps = f"regexp_extract_all(text, '{pattern}', 0)", f"string_split_regex(text, '{pattern}')"
    held, before = f"regexp_extract_all(text, '{pattern}', {group})", f"regexp_extract_all(text, '{pattern}', 1)" if lead else "NULL"
    at = "(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT"
    start = f"{at} + length(b[i])" if lead else at
    return f"""(SELECT list_transform(list_filter(range(1, len(h) + 1), lambda i: length(k[i]) >= {least}), lambda i: {{'s': {start}, 'k': {kind}, 'e': {at} + length(h[i])}}) FROM (SELECT {hits} AS h, {gaps} AS g, {held} AS k, {before} AS b))"""


def _op9(reach: int = 200) -> str:
    kinds = [*secrets.BASE, *secrets.WEAK]
    lists = ", ".join(f"{_spans(i, p, g, n)} AS l{i}" for i, (_, p, g, n) in enumerate(kinds))
    names = "[" + ", ".join(f"'{k}'" for k, *_ in kinds) + "]"
    roles = "[" + ", ".join(f"'{secrets.ROLE[k]}'" for k, *_ in kinds) + "]"
    base = " || ".join(f"l{i}" for i in range(3))
    weak = " || ".join(f"l{i}" for i in range(3, len(kinds)))
    text = f"array_to_string(list_transform(list_sort({{}}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, {lists} FROM t),
b AS (SELECT *, {base} AS base, {weak} AS weak FROM f),
n AS (SELECT *, list_filter(weak, lambda w: len(list_filter(base || weak, lambda o: {roles}[o.k + 1] <> {roles}[w.k + 1] AND ((o.s >= w.s - {reach} AND o.s <= w.e + {reach}) OR (o.e >= w.s - {reach} AND o.e <= w.e + {reach})))) > 0) AS added FROM b)
SELECT doc_id, len(l0)::BIGINT AS n_assign, len(l1)::BIGINT AS n_access, len(l2)::BIGINT AS n_hex, sha256({text.format('base')}) AS base_sha256, {text.format('base || list_distinct(added)')} AS spans FROM n
"""


OP11 = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT row, pos, md5(b[pos + 1:pos + 200]) AS h FROM (SELECT row, b, unnest(range(octet_length(b) - 199)) AS pos FROM d WHERE octet_length(b) >= 200)),
again AS (SELECT row, pos FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1)),
begun AS (SELECT row, pos, coalesce(pos - lag(pos) OVER o > 200, true)::INT AS new FROM again WINDOW o AS (PARTITION BY row ORDER BY pos)),
spans AS (SELECT row, no, min(pos) AS start, max(pos) + 200 AS end FROM (SELECT row, pos, sum(new) OVER (PARTITION BY row ORDER BY pos) AS no FROM begun) GROUP BY 1, 2),
gaps AS (SELECT row, no, coalesce(lag("end") OVER o, 0) AS low, start AS high FROM spans WINDOW o AS (PARTITION BY row ORDER BY no)
  UNION ALL SELECT d.row, 1 + coalesce(max(no), 0), coalesce(max("end"), 0), octet_length(any_value(b)) FROM d LEFT JOIN spans USING (row) GROUP BY 1),
kept AS (SELECT row, string_agg(hex(b[low + 1:high]), '' ORDER BY no) AS k FROM gaps JOIN d USING (row) GROUP BY 1),
n AS (SELECT row, sum("end" - start) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (row) LEFT JOIN n USING (row)
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(t)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || x[i:i + 7])::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT row, lang, source, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (coalesce(s.total, 0) + v.v) AS p, 1 + 1000000000 * (k.n + 1)::HUGEINT // (v.total + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""


ORACLES = {"op1_source_mixing": OP1, "op2_line_dedup": OP2, "op4_exact_top_k": OP4, "op9_secret_scans": _op9(), "op11_suffix_dedup": OP11, "op12_fill_in_middle": OP12, "op13_source_divergence": OP13}
