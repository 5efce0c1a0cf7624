"""DuckDB SQL of the training-data queries that SQL can express.

The others need a tokeniser (3, 8), a learned model (2, 10) or hashes of their own (4); they are tested against plain
Python or held-out labels in tests/llm.
"""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP5 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM v) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS words FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Base32 of SHA-1: five hex digits give four letters.
_LETTERS = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[{5 * g + 1}:{5 * g + 5}])::BIGINT >> {s}) & 31) + 1]" for g in range(8) for s in (15, 10, 5, 0))

OP6 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, n AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p
"""

OP7 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {FOLDED} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS h FROM s GROUP BY doc_id),
c AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS rep FROM n),
r AS MATERIALIZED (SELECT s.doc_id, k, n FROM s JOIN c ON c.doc_id = s.doc_id AND c.rep = s.doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT doc_id AS x, doc_id AS y FROM c WHERE rep = doc_id UNION SELECT t.x, e.b FROM t JOIN e ON e.a = t.y),
m AS (SELECT x, min(y) AS least FROM t GROUP BY x)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.x = c.rep
"""

_KINDS = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16), ("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20))


def _found(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    return f"""SELECT doc_id, source, repository, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS size, v[i] AS value
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, concat_ws('/', source, lang) AS repository, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, string_split_regex(text, '{pattern}') AS g FROM documents)) WHERE length(v[i]) >= {least}"""


OP1 = f"""
WITH f AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, repository, kind, rank, a::BIGINT AS a, (a + size)::BIGINT AS b, value FROM ({" UNION ALL ".join(_found(*k, rank) for rank, k in enumerate(_KINDS))})),
base AS MATERIALIZED (SELECT * FROM f WHERE kind <> 'owned'),
bare AS MATERIALIZED (SELECT * FROM f WHERE kind = 'owned' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = f.doc_id AND base.a < f.b AND f.a < base.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owners AS (SELECT value, count(DISTINCT source) AS o, count(DISTINCT (source, repository)) AS r, count(*) AS u FROM every GROUP BY value),
j AS MATERIALIZED (SELECT every.*, o, owners.r AS r, u, o >= 3 OR owners.r >= 4 AS copied FROM every JOIN owners USING (value)),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind <> 'owned') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind <> 'owned' OR NOT copied) AS spans,
    count(*) FILTER (kind = 'owned' AND NOT copied) AS n_owned, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied, max(o) AS o, max(r) AS r, max(u) AS u FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
    coalesce(o, 0) AS max_owners, coalesce(r, 0) AS max_repositories, coalesce(u, 0) AS max_uses FROM documents d LEFT JOIN s USING (doc_id)
"""



def _covered(n: int) -> str:
    """Words of windows of n words that the text has twice or more."""
    return f"SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n}))) WHERE c > 1"


_COVER = (5, 10, 20)
_SUMS = ",\n".join(f"c{n} AS (SELECT x.doc_id, sum(length(x.word))::BIGINT AS c{n} FROM x JOIN ({_covered(n)}) g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)" for n in _COVER)

OP9 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
r AS (SELECT doc_id, count(*) AS r FROM ({_covered(3)}) GROUP BY doc_id),
{_SUMS},
l AS (SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS kinds, sum(length(line)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
o AS (SELECT doc_id, sum(length(line)) AS once FROM (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda t: length(t))), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines - kinds, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0)::BIGINT AS n_lines, coalesce(chars - once, 0)::BIGINT AS dup_line_chars, coalesce(chars, 0)::BIGINT AS line_chars,
    {", ".join(f"coalesce(c{n}, 0)::BIGINT AS cover_{n}_chars" for n in _COVER)}
    FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN o USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in _COVER)})
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * dup_line_chars > 30 * line_chars
    OR 100 * n_symbols > 25 * n_words OR 100 * cover_5_chars > 35 * word_chars OR 100 * cover_10_chars > 30 * word_chars OR 100 * cover_20_chars > 25 * word_chars) AS kept FROM f
"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, from the 256 remainders of ``crc_table``, which the query joins."""
    step = "lambda a, x: xor(a >> 8, crc_table.r[(xor(a, x) & 255) + 1])"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), {step}, 4294967295::BIGINT), 4294967295)"


_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) ORDER BY n) AS r FROM range(256) AS t(n))"
_LAST = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

#: A state is the initial of the last turn that stays, '' at the start; the recursion goes over turns and keeps all that lead to a state before the cheapest is taken.
OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc_table),
d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
t AS MATERIALIZED (SELECT conv_id, turn, role, text, left(role, 1) AS x, i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN {_LAST} = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right({_LAST}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS z, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS told FROM conversations
    UNION ALL
    SELECT conv_id, i, z, cost, audit, told FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) AS r FROM (
        SELECT g.conv_id, t.i, CASE WHEN e = 'D' THEN g.z WHEN e = 'K' THEN t.x ELSE n END AS z, g.cost + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, g.audit || e AS audit,
            CASE WHEN e = 'D' THEN g.told ELSE list_append(g.told, CASE WHEN e = 'K' THEN t.role WHEN n = 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text) END AS told
        FROM (SELECT *, CASE z WHEN 'u' THEN 'a' ELSE 'u' END AS n FROM (SELECT * FROM s UNION ALL SELECT conv_id, i, CASE z WHEN 'u' THEN 'a' ELSE 'u' END, cost + 5, audit || 'I', list_append(told, CASE z WHEN 'u' THEN 'assistant:' ELSE 'user:' END) FROM s)) g
        JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.i = g.i + 1, (VALUES ('D'), ('K'), ('R')) AS v(e)
        WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR t.x = n OR t.x = 's' AND g.z = '')))
    WHERE r = 1),
f AS (SELECT conv_id, cost, audit, told FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC, cost, audit) AS r FROM (SELECT conv_id, i, z, cost, audit, told FROM s UNION ALL SELECT conv_id, i, 'a', cost + 5, audit || 'I', list_append(told, 'assistant:') FROM s WHERE z = 'u') WHERE z IN ('', 'a')) WHERE r = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(array_to_string(told, chr(10))) AS repaired_sha256 FROM f LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM f.conv_id
"""

OP12 = f"""
WITH {_CRC_TABLE},
o AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (SELECT c, {_crc32("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM o), crc_table),
b AS (SELECT h.c, o.i, role, text FROM h JOIN o ON o.c = h.c - h.c % 5 AND o.i <= h UNION ALL SELECT h.c, 1000000 + o.i, role, text FROM h JOIN o ON o.c = h.c AND o.i > h),
r AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, sha256(strlen(role) || ':' || role || text) AS k, strlen(text) AS size FROM b),
p AS MATERIALIZED (SELECT c, 0::BIGINT AS d, '' AS p, 0 AS size FROM h UNION ALL SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d), size FROM r),
n AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM p GROUP BY p, d),
kids AS (SELECT q.p AS p, count(*) AS n FROM n JOIN (SELECT c, d, p FROM p) q ON q.c = n.conv_id AND q.d = n.d - 1 GROUP BY q.p),
leaves AS (SELECT q.p AS p, count(*) AS n FROM n JOIN p q ON q.c = n.conv_id AND q.d <= n.d WHERE n.p NOT IN (SELECT p FROM kids) GROUP BY q.p),
saved AS (SELECT q.p AS p, sum((n_convs - 1) * n.size)::BIGINT AS n FROM n JOIN p q ON q.c = n.conv_id AND q.d <= n.d GROUP BY q.p),
ends AS (SELECT p, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(p, d) AS p FROM p GROUP BY c) GROUP BY p)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves.n AS n_leaves, saved.n AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN leaves USING (p) JOIN saved USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p) LEFT JOIN n u ON u.d = n.d - 1 AND u.p = left(n.p, length(n.p) - 64)
"""

_ALPHANUMERIC = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ALPHANUMERIC} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {_ALPHANUMERIC} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
v AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
f AS MATERIALIZED (SELECT doc_id, k, n, id FROM v JOIN p USING (n, t)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) FROM f) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_secrets": OP1, "op5_substring_dedup": OP5, "op6_warc": OP6, "op7_jaccard_join": OP7, "op9_quality_rules": OP9, "op11_conversation_repair": OP11, "op12_conversation_trie": OP12, "op13_decontamination": OP13}
