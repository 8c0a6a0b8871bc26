"""DuckDB SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
NON_SPACE = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

OP8 = f"""
WITH it AS (SELECT item_id, {ALNUM} w FROM benchmark),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') k
       FROM (SELECT item_id, w, least(len(w), 10) l, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) i FROM it WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () rid, doc_id, {ALNUM} w FROM documents),
dw AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') k
       FROM (SELECT rid, w, l, unnest(generate_series(1, len(w) - l + 1)) i FROM d, (SELECT DISTINCT l FROM iw))),
hits AS (SELECT rid, i, l, item_id FROM dw JOIN iw USING (l, k)),
hw AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(generate_series(i, i + l - 1)) p FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(*) n, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT rid, item_id::VARCHAR id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(hw.n, 0)::BIGINT n_hit, coalesce(hi.n, 0)::BIGINT n_items,
       sha256(coalesce(hi.ids, '')) items_sha256, coalesce(hw.n, 0) > 0 contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {NON_SPACE} w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + l - 1], ' ') k
      FROM (SELECT doc_id, w, least(len(w), 3) l, unnest(generate_series(1, len(w) - least(len(w), 3) + 1)) i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
r AS (SELECT doc_id id, doc_id c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, m.c component_id, d.doc_id = m.c kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""


CLASS = "".join(chr(c) for a, b in ((0x61, 0x7B), (0xE0, 0x100)) for c in range(a + 1, b, 4)) + "13579Ā-Šα-θа-иא-זا-خ"

#: As in line_dedup
OTHER = "\u0530-\u058F\u0700-\u1DFF\u2C00-\U0010FFFF"
UNSPACED = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\uFE30-\uFE4F\uFF00-\uFFEF\U00020000-\U0003FFFD"

OP2 = rf"""
WITH d0 AS (SELECT row_number() OVER () rid, coalesce(doc_id, 9223372036854775807) key, ('0x' || substr(md5(text), 1, 15))::BIGINT dig, doc_id, text,
                  list_filter(regexp_extract_all(text, '(?s).*?(?:\n|[.!?] |[{CLASS}][{CLASS}] |[{OTHER}] |[{UNSPACED}]|\z)'), lambda x: x <> '') ws FROM documents),
w0 AS (SELECT rid, i, ws[i] w FROM (SELECT rid, ws, unnest(generate_series(1, len(ws))) i FROM d0)),
w1 AS (SELECT *, CASE WHEN regexp_matches(w, '(?:\n|[.!?] |[{CLASS}][{CLASS}] )\z') OR (ascii(w) * 7 + ascii(substr(w, 2, 1)) * 3 + length(w) * 5) % 4 < 1 THEN 1 ELSE 0 END e FROM w0),
w2 AS (SELECT rid, i, w, sum(e) OVER (PARTITION BY rid ORDER BY i) - e ln FROM w1),
w3 AS (SELECT rid, ln, string_agg(w, '' ORDER BY i) l FROM w2 GROUP BY rid, ln),
w4 AS (SELECT rid, list(l ORDER BY ln) ls FROM w3 GROUP BY rid),
d AS (SELECT d0.rid, key, dig, doc_id, text, CASE WHEN text IS NOT NULL THEN coalesce(ls, []) END ls FROM d0 LEFT JOIN w4 USING (rid)),
l AS (SELECT rid, i - 1 i, len(ls) n, ascii(md5(rtrim(ls[i], ' ' || chr(10)))) h, ends_with(ls[i], chr(10)) e
      FROM (SELECT rid, ls, unnest(generate_series(1, len(ls))) i FROM d)),
m AS (SELECT rid, i, n, i = 0 OR lag(e) OVER w OR coalesce((h * 7 + lead(h) OVER w * 3) % 10 < 9, false) s,
             i = n - 1 OR e OR coalesce((lag(h) OVER w * 3 + h * 7) % 11 < 10, false) f FROM l WINDOW w AS (PARTITION BY rid ORDER BY i)),
p AS (SELECT s.rid, s.i pos, least(coalesce(min(f.i) - s.i + 1, 8), 8, any_value(s.n) - s.i) n
      FROM m s LEFT JOIN m f ON f.rid = s.rid AND f.f AND f.i BETWEEN s.i + 2 AND s.i + 6 WHERE s.s AND s.i + 3 <= s.n GROUP BY s.rid, s.i),
c AS (SELECT rid, key, dig, pos, n, array_to_string(ls[pos + 1:pos + n - 1], '') || rtrim(ls[pos + n], ' ' || chr(10)) body FROM p JOIN d USING (rid)
      UNION ALL SELECT rid, key, dig, 0, len(ls), array_to_string(ls[1:len(ls) - 1], '') || rtrim(ls[len(ls)], ' ' || chr(10)) FROM d WHERE len(ls) > 1),
e AS (SELECT * FROM c WHERE len(regexp_extract_all(body, '[^\x20\x09-\x0D{UNSPACED}]+|[{UNSPACED}]')) >= 10),
f AS (SELECT body, min({{k: key, d: dig, p: pos}}) f FROM e GROUP BY body),
g AS (SELECT DISTINCT rid, unnest(generate_series(pos, pos + n - 1)) i FROM e JOIN f USING (body) WHERE {{k: key, d: dig, p: pos}} > f),
k AS (SELECT rid, count(g.i) r, string_agg(CASE WHEN g.i IS NULL THEN d.ls[l.i + 1] ELSE '' END, '' ORDER BY l.i) t FROM l JOIN d USING (rid) LEFT JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(k.r, 0)::BIGINT n_removed,
       coalesce(length(text) - length(coalesce(k.t, text)), 0)::BIGINT chars_removed, coalesce(k.t, text) "text"
FROM d LEFT JOIN k USING (rid)
"""

OP4 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
SELECT query_id, rank::INT rank, vec_id, score FROM r WHERE rank <= 20
"""

BASE32 = "array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '')"

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') t, sha1(coalesce(html, '')) h FROM pages),
m AS (SELECT t, max(page_id) last FROM p GROUP BY t)
SELECT page_id, octet_length(encode(t))::BIGINT payload_bytes, {BASE32} payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> last THEN last END refers_to
FROM p JOIN m USING (t)
"""


def digest60(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', " + ", ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts) + ")), 1, 15))::BIGINT"


OP7 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) sid, 1.5::DOUBLE * sum(source_size) OVER () total, 2.0::DOUBLE * source_size cap FROM s),
b AS (SELECT *, [3, 1, 2][((sid - 1) % 3 + 1)::INT] weight FROM a),
c AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) rest0,
             sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) weights FROM b),
e AS (SELECT *, cap * weights <= rest0 * weight whole_cap FROM c),
f AS (SELECT *, CASE WHEN whole_cap THEN cap ELSE max(CASE WHEN NOT whole_cap THEN rest0 / weights END) OVER () * weight END target FROM e),
g AS (SELECT *, least(floor(target + 0.5), floor(cap))::BIGINT quota, greatest(ceil(sqrt(source_size)), 1)::BIGINT n_blocks FROM f),
h AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END whole FROM g),
x AS (SELECT doc_id, size, h.*, quota - whole * source_size rest, {digest60("'mix/block'", "doc_id")} % n_blocks block
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
y AS (SELECT sid, block, sum(size) words, {digest60("'mix/order'", "sid", "block")} o FROM x GROUP BY sid, block),
z AS (SELECT *, sum(words) OVER (PARTITION BY sid ORDER BY o, block) - words before FROM y),
t AS (SELECT x.*, greatest(least(rest - before, words), 0) part,
             sum(size) OVER (PARTITION BY x.sid, x.block ORDER BY {digest60("'mix/doc'", "doc_id")}, doc_id, size ROWS UNBOUNDED PRECEDING) - size seen
      FROM x JOIN z USING (sid, block))
SELECT doc_id, size, source_size, target, (whole * size + greatest(least(part - seen, size), 0))::BIGINT taken FROM t
"""

OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
g AS (SELECT t, min(doc_id) low FROM d GROUP BY t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) good, bool_or(coalesce(toxic = 1, false)) toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, part, t, low, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w FROM d JOIN g USING (t)),
f AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > low THEN 'E' ELSE '' END fails,
             coalesce(good, false) good, coalesce(toxic, false) toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) n, count(*) FILTER (good) good, count(*) FILTER (toxic) toxic FROM f GROUP BY ALL),
p AS (SELECT '' o UNION ALL SELECT o || x FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE strpos(o, x) = 0),
s AS (SELECT o, i step, o[i] x, o[1:i - 1] before FROM p, generate_series(1, 5) g(i) WHERE length(o) = 5),
m AS (SELECT s.*, c.*, strpos(fails, x) > 0 own, translate(before, fails, '') = before reached FROM s, c),
r AS (SELECT part, o filter_order, step::INT step, any_value(x) x, coalesce(sum(n) FILTER (NOT own AND reached), 0)::BIGINT kept,
             coalesce(sum(n) FILTER (own AND reached), 0)::BIGINT removed, coalesce(sum(n) FILTER (own AND NOT reached), 0)::BIGINT redundant,
             coalesce(sum(n) FILTER (fails = x), 0)::BIGINT unique_fails, coalesce(sum(good) FILTER (own AND reached), 0)::BIGINT good_lost,
             coalesce(sum(toxic) FILTER (own AND reached), 0)::BIGINT toxic_lost FROM m GROUP BY ALL)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT shapley FROM r
"""

SQL = {"op2_line_dedup": OP2, "op4_nearest": OP4, "op5_warc": OP5, "op7_mix": OP7, "op8_decontaminate": OP8, "op9_near_duplicates": OP9, "op11_filter_audit": OP11}
