"""DuckDB SQL that gives the rows of those training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LPF_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(range(0, octet_length(b) - 99)) AS p FROM d WHERE octet_length(b) >= 100),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_slice(b, p + 1, p + 100) ORDER BY doc_id, p) AS n FROM w JOIN d USING (doc_id)),
g AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS opens FROM f WHERE n > 1),
i AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS z FROM i GROUP BY doc_id, span),
t AS (SELECT doc_id, octet_length(b) AS n_bytes, b FROM d),
cut AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, z FROM s),
pieces AS (SELECT doc_id, a AS pos, hex(array_slice(b, since + 1, a)) AS h FROM cut JOIN t USING (doc_id) UNION ALL
  SELECT doc_id, n_bytes + 1, hex(array_slice(b, coalesce(z, 0) + 1, n_bytes)) FROM t LEFT JOIN (SELECT doc_id, max(z) AS z FROM s GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(h, '' ORDER BY pos) AS h FROM pieces GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

MERKLE_AUDIT = r"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url, page_id // 256 AS archive,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
h AS (SELECT page_id, url, archive, strlen(record)::BIGINT AS length, sha256(record) AS digest FROM r)
SELECT page_id, archive::BIGINT AS archive, row_number() OVER w - 1 AS seq, coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, digest,
CASE WHEN page_id % 389 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'corrupt' ELSE 'ok' END AS status FROM h WINDOW w AS (PARTITION BY archive ORDER BY page_id, url, digest)"""

_SEARCH_WORDS = r"list_filter(regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_SEARCH_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_SEARCH_WORDS} AS w FROM benchmark),
q AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item_id, i, x.n FROM x JOIN q USING (n, k)),
m AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _escaped(column: str) -> str:
    text = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"):
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


CHAT_TEMPLATE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE role WHEN 'user' THEN 18 + length({_escaped("text")}) WHEN 'assistant' THEN 5 + length({_escaped("text")}) ELSE 20 + length({_escaped("role")}) + length({_escaped("text")}) END AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(reached) FROM r WHERE node = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

_CRC_STEP = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"

TURN_REPAIR = rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hurt AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)), {_CRC_STEP}), 4294967295) % 20 AS kind FROM given),
copies AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hurt WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM copies),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM numbered),
t AS (SELECT *, left(role, 1) AS first, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
ins(a, b, c, e) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
step(fault, first, a, b, c, e) AS (
  SELECT f, r, s, s, 2, 'D' FROM (VALUES ('b'), ('d'), ('t'), ('')) x(f), (SELECT DISTINCT first FROM t) y(r), (VALUES (0), (1), (2), (3)) z(s) UNION ALL
  SELECT f, r, a, b, CASE WHEN f = 't' THEN 5 ELSE 0 END, 'K' FROM (VALUES ('t'), ('')) x(f), (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) g(r, a, b) UNION ALL
  SELECT f, r, a, b, CASE WHEN f = 't' THEN 6 ELSE 1 END, 'R' FROM (VALUES ('t'), ('')) x(f), (SELECT DISTINCT first FROM t) y(r), (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) g(a, b)),
w AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit FROM n UNION ALL
  SELECT conv_id, i, s, best.cost, best.audit FROM (SELECT t.conv_id, t.i, step.b AS s, min({{'cost': w.cost + ins.c + step.c, 'audit': w.audit || ins.e || step.e}}) AS best
    FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN ins ON ins.a = w.s JOIN step ON step.a = ins.b AND step.fault = t.fault AND step.first = t.first GROUP BY t.conv_id, t.i, step.b)),
done AS (SELECT conv_id, min({{'cost': cost + c, 'audit': audit || e}}) AS best FROM w JOIN n USING (conv_id) JOIN ins ON ins.a = s AND ins.b IN (0, 3) WHERE w.i = n.n GROUP BY conv_id),
letters AS (SELECT conv_id, pos, substr(best.audit, pos, 1) AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS pos FROM done)),
left_over AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS out FROM (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM letters) WHERE letter <> 'D'),
begun AS (SELECT conv_id, max((out = 1 AND letter = 'K' AND t.first = 's')::INT) AS shift FROM left_over l LEFT JOIN t USING (conv_id, i) GROUP BY conv_id),
said AS (SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN t.role WHEN (out - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY out) AS repaired
  FROM left_over l JOIN begun USING (conv_id) LEFT JOIN t ON t.conv_id = l.conv_id AND t.i = l.i GROUP BY l.conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id) LEFT JOIN done USING (conv_id) LEFT JOIN said USING (conv_id)"""


def _grams(k: int) -> str:
    return f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p WHERE len(w) >= {k})"


COLLOCATIONS = rf"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM
  (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, g, count(*) AS f FROM ({" UNION ALL ".join(map(_grams, range(1, 6)))}) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, c.k, g, c.f AS a, j, array_to_string(w[:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c),
s AS (SELECT cuts.*, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = x JOIN f r ON r.lang = cuts.lang AND r.g = y JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT a.lang, a.g FROM c a JOIN c z ON z.lang = a.lang AND z.k > a.k AND contains(' ' || z.g || ' ', ' ' || a.g || ' ') WHERE 100 * z.f >= 100 * a.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, score FROM b ANTI JOIN gone USING (lang, g)
QUALIFY rank <= 2000"""
