"""DuckDB SQL for the queries, built from the same lexicons but with SQL's own means."""

from __future__ import annotations

from vellum.functions import lexicons as lex
from vellum.plans import fixtures as fx

lit, CUT = fx.literal, "chr(1)"


def strings(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def norm(t: str) -> str:
    return f"trim(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g'))"


def sentences(t: str) -> str:
    return f"list_filter(string_split(regexp_replace({norm(t)}, '([.!?]) +', '\\1' || {CUT}, 'g'), {CUT}), lambda x: x <> '')"


def any_of(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {lit(w)})" for w in words) + ")"


def found(t: str, words) -> str:
    return f"array_to_string(list_filter({strings(words)}, lambda k: contains(lower({t}), k)), '|')"


def labels(t: str, pairs: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN contains(lower({t}), {lit(k)}) THEN {lit(v)} END" for k, v in pairs.items()) + ")"


def tokens(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[A-Za-z0-9]+|[\\x{{0600}}-\\x{{06FF}}]+'), lambda k: length(k) > 1 AND NOT list_contains({strings(lex.QUESTION_STOP_WORDS)}, k))"


def keywords(t: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-zA-Z0-9]+'), lambda k: length(k) > 2 AND NOT list_contains({strings(lex.COMPARISON_STOP_WORDS)}, k)))"


def numbers(t: str) -> str:
    return f"list_distinct(regexp_extract_all({t}, '\\b\\d+(?:\\.\\d+)?\\b'))"


def _first_ci(parts: str, key: str, name: str, test: str) -> str:
    """Parts (key, raw list) to lists of the normalised ones that pass a test, first of those equal but for case, in order."""
    return f"""SELECT {key}, coalesce(list(x ORDER BY pos) FILTER (r = 1), []) AS {name} FROM (SELECT {key}, x, pos, CASE WHEN x IS NOT NULL AND {test} THEN row_number() OVER (PARTITION BY {key}, (x IS NOT NULL AND {test}), lower(x) ORDER BY pos) END AS r
        FROM (SELECT {key}, pos, x FROM ({parts}))) GROUP BY {key}"""


def _words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"


def items_of(source: str, key: str, text: str = "text") -> str:
    raw = f"string_split(regexp_replace(regexp_replace({text}, '([.!?])\\s+', '\\1' || {CUT}, 'g'), '\\n+', {CUT}, 'g'), {CUT})"
    parts = f"SELECT {key}, {norm('y')} AS x, pos FROM (SELECT {key}, unnest(raw) AS y, generate_subscripts(raw, 1) AS pos FROM (SELECT {key}, {raw} AS raw FROM ({source})))"
    return _first_ci(parts, key, "items", f"{_words('x')} >= 3")


def mail_sentences(source: str) -> str:
    raw = f"string_split(regexp_replace({norm('text')}, '([.!?])\\s+', '\\1' || {CUT}, 'g'), {CUT})"
    parts = f"SELECT doc_id, trim({norm('y')}, ' -•') AS x, pos FROM (SELECT doc_id, unnest(raw) AS y, generate_subscripts(raw, 1) AS pos FROM (SELECT doc_id, {raw} AS raw FROM ({source})))"
    return _first_ci(parts, "doc_id", "s", f"{_words('x')} >= 3")


def passages(source: str) -> str:
    raw = f"string_split(regexp_replace(regexp_replace(text, '\\n{{2,}}', {CUT}, 'g'), '([.!?؟])\\s+', '\\1' || {CUT}, 'g'), {CUT})"
    parts = f"SELECT doc_id, trim({norm('y')}, ' -•') AS x, pos FROM (SELECT doc_id, unnest(raw) AS y, generate_subscripts(raw, 1) AS pos FROM (SELECT doc_id, {raw} AS raw FROM ({source})))"
    return _first_ci(parts, "doc_id", "p", f"len({tokens('x')}) >= 3")


def short(x: str) -> str:
    return f"CASE WHEN length({x}) <= 180 THEN {x} ELSE regexp_replace({x}[1:180], ' [^ ]*$', '') || '...' END"


def first_items(source: str, words) -> str:
    return f"""SELECT doc_id, length(i) AS n, md5(array_to_string(i, '|')) AS items_md5 FROM (SELECT doc_id, list_filter(i, lambda x, k: list_position(list_transform(i, lambda y: lower(y)), lower(x)) = k)[1:5] AS i
        FROM (SELECT doc_id, list_transform(list_filter(s, lambda x: {any_of('lower(x)', words)}), lambda x: {short('x')}) AS i FROM {source}))"""


def mail_summary(source: str, words) -> str:
    return f"""WITH m AS ({mail_sentences(source)}), a AS (SELECT doc_id, list_transform(s, lambda x: {short('x')}) AS every, list_transform(list_filter(s, lambda x: {any_of('lower(x)', words)}), lambda x: {short('x')})[1:4] AS lead FROM m),
        r AS (SELECT *, list_filter(every, lambda x, i: NOT list_contains(lead, x) AND list_position(every, x) = i) AS other FROM a), f AS (SELECT doc_id, CASE WHEN length(lead) < 3 THEN list_concat(lead, other)[1:4] ELSE lead END AS s FROM r)
        SELECT doc_id, CASE WHEN length(s) = 0 THEN 1 ELSE length(s) END AS n, md5(CASE WHEN length(s) = 0 THEN {lit(lex.UNCONFIRMED)} ELSE array_to_string(s, '|') END) AS summary_md5 FROM f"""


def mail_report(source: str) -> str:
    when = f"CASE WHEN {any_of('lower(d.text)', fx.DATA_PHRASES[2:4])} THEN 'High' WHEN {any_of('lower(d.text)', fx.DATA_TERMS)} THEN 'Medium' ELSE 'Normal' END"
    return f"""WITH d AS ({source}), m AS ({mail_sentences(source)}), a AS ({first_items('m', fx.DATA_WORDS)}), b AS ({first_items('m', fx.DATA_TERMS)}), s AS ({mail_summary(source, [*fx.DATA_WORDS, *fx.DATA_TERMS])})
        SELECT d.doc_id, 'Email Summary' || chr(10) || chr(10) || 'From: ' || source || chr(10) || 'To: ' || lang || chr(10) || 'Subject: note ' || d.doc_id || chr(10) || 'Priority: ' || {when} AS head,
        s.n + greatest(1, a.n) + 1 + greatest(1, b.n) + 2 AS n_bullets FROM d JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN s USING (doc_id)"""


def section_rows(sections: dict[str, list[str]]) -> str:
    return fx.values([(s, i, k, j) for i, (s, ks) in enumerate(sections.items()) for j, k in enumerate(ks)], "section", "pos", "keyword", "kpos")


def checklist(source: str, sections: dict[str, list[str]]) -> str:
    return f"""SELECT doc_id, pos, section, CASE WHEN length(e) > 0 THEN 'Detected' ELSE 'Missing or unclear' END AS status, CASE WHEN length(e) > 0 THEN array_to_string(e[1:4], ', ') ELSE 'No clear evidence detected' END AS evidence
        FROM (SELECT doc_id, pos::BIGINT AS pos, section, coalesce(list(keyword ORDER BY kpos) FILTER (contains(t, keyword)), []) AS e FROM (SELECT doc_id, lower({norm('text')}) AS t FROM ({source}) WHERE {norm('text')} <> ''), {section_rows(sections)} GROUP BY doc_id, pos, section)"""


def _dealt(key: str, values: list) -> str:
    return f"({strings(values)})[{key} % {len(values)} + 1]"


def planted() -> str:
    """All documents behind one of the planted texts each; a blank one stands alone."""
    kind, text = (_dealt("doc_id", [d[i] for d in fx.DOCUMENTS]) for i in (1, 2))
    return f"SELECT doc_id, kind, CASE WHEN trim(lead) = '' THEN lead ELSE lead || ' ' || text END AS text FROM (SELECT doc_id, {kind} AS kind, {text} AS lead, text FROM documents)"


def planted_reviews() -> str:
    docs = f"SELECT doc_id, upper(trim(kind)) AS kind, text, {norm('text')} AS t FROM ({planted()})"
    part = lambda kind, sections: checklist(f"SELECT doc_id, text FROM d WHERE kind = '{kind}'", sections)
    weak = lambda: f"list_concat(CASE WHEN contains(lower(s), 'should') THEN ['A requirement uses ''should'', which may be optional or unclear: ' || s] ELSE [] END, CASE WHEN {_words('s')} < 5 THEN ['A requirement may be too short or incomplete: ' || s] ELSE [] END)"
    return f"""WITH d AS ({docs}), c AS ({part('BRD', lex.BRD_SECTIONS)} UNION ALL {part('SRS', lex.SRS_SECTIONS)}),
        g AS (SELECT doc_id, round_even(100.0 * count(*) FILTER (status = 'Detected') / count(*), 0)::BIGINT AS completeness, coalesce(string_agg(section, '|' ORDER BY pos) FILTER (status = 'Detected'), '') AS detected, coalesce(string_agg(section, '|' ORDER BY pos) FILTER (status <> 'Detected'), '') AS missing FROM c GROUP BY doc_id),
        i AS (SELECT doc_id, list_concat(list_transform(list_filter({strings(lex.VAGUE_PHRASES)}, lambda p: contains(lower(t), p)), lambda p: 'Vague wording detected: ''' || p || '''. Replace it with a measurable or specific statement.'),
            flatten(list_transform(list_filter({sentences('text')}, lambda s: {any_of('lower(s)', lex.REQUIREMENT_TERMS)}), lambda s: {weak()}))) AS issues FROM d)
        SELECT d.doc_id, CASE WHEN t = '' THEN 'EMPTY_DOC' WHEN kind NOT IN ('BRD', 'SRS') THEN 'BAD_DOC_TYPE' END AS error_code, completeness, detected, missing,
        CASE WHEN g.doc_id IS NULL THEN NULL ELSE md5(CASE WHEN length(issues) = 0 THEN 'No basic wording issues were detected by the rule-based review. Human review is still required.' ELSE array_to_string(issues, '|') END) END AS issues_md5,
        CASE WHEN missing = '' THEN 'Review each section for accuracy, traceability, and formal approval.' ELSE array_to_string(list_transform(string_split(missing, '|'), lambda s: 'Add or clarify the ''' || s || ''' section.'), '|') END AS recommendations
        FROM d LEFT JOIN g USING (doc_id) JOIN i USING (doc_id)"""


def service_name(t: str) -> str:
    every = ", ".join(f"nullif(regexp_extract({norm(t)}, '(?i){v} (?:a|an|the) ([^.]*?service)', 1), '')" for v in lex.SERVICE_VERBS)
    return f"coalesce((SELECT upper(trim(x)[1]) || lower(trim(x)[2:]) FROM (SELECT coalesce({every}) AS x)), {lit(lex.UNCONFIRMED)})"


def planted_outlines() -> str:
    or_else = lambda x: f"CASE WHEN t = '' THEN NULL ELSE coalesce(nullif({x}, ''), {lit(lex.UNCONFIRMED)}) END"
    some = lambda words: f"array_to_string(list_filter(s, lambda x, i: {any_of('lower(x)', words)} AND list_position(s, x) = i), '|')"
    return f"""SELECT doc_id, CASE WHEN t = '' THEN 'EMPTY_SOURCE' END AS error_code, {or_else(labels('t', lex.STAKEHOLDERS))} AS stakeholders, {or_else(labels('t', lex.RECIPIENTS))} AS service_recipients,
        md5({or_else(some(lex.FUNCTIONAL_VERBS))}) AS functional_md5, md5({or_else(some(lex.RULE_CUES))}) AS rules_md5, {or_else(labels('t', lex.REQUIRED_INFORMATION))} AS required_data_and_documents
        FROM (SELECT doc_id, {norm('text')} AS t, {sentences('text')} AS s FROM ({planted()}))"""


DEADLINE_CASES = ["Send it by tomorrow please now", "Due 2026-08-01 at the latest", "We took 3/4 of it", "by EOD is fine for us", "by Friday is fine for us", "end of week is fine too", "next week we meet", "by 5-6-26 or never", "no date in here at all", "Todayish is not one day"]


def planted_deadlines() -> str:
    """Every sentence of all documents, every second one with a planted case behind it."""
    hit = " OR ".join(f"regexp_matches(x, {lit('(?i)' + p)})" for p in lex.DEADLINES)
    rows = f"SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)"
    return f"SELECT doc_id, pos, ({hit}) AS is_deadline FROM (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN s || ' ' || {_dealt('(doc_id + pos // 2)', DEADLINE_CASES)} ELSE s END AS x FROM ({rows}))"


def hints(t: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN list_has_any({tokens(norm(t))}, {strings(words)}) THEN {lit(name)} END" for name, words in lex.QUESTION_HINTS.items()) + ")"


def planted_hints() -> str:
    return f"SELECT doc_id, {hints('q')} AS hints FROM (SELECT doc_id, {_dealt('doc_id', [q[2] for q in fx.QUESTIONS])} || ' ' || text[1:{fx.OPENING}] AS q FROM documents)"


def overlaps() -> str:
    return f"""SELECT q_id, s_id, pos, terms, count(*) AS shared FROM (SELECT doc_id AS s_id, pos, unnest(list_distinct({tokens('x')})) AS term FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS pos FROM ({passages('SELECT doc_id, text FROM documents')})))
        JOIN (SELECT q_id, length(q) AS terms, unnest(q) AS term FROM (SELECT item_id AS q_id, list_distinct({tokens(norm('text'))}) AS q FROM benchmark)) USING (term) GROUP BY ALL"""


def _pairs() -> str:
    return f"""WITH i AS MATERIALIZED ({items_of('SELECT doc_id, text FROM documents', 'doc_id')}), u AS MATERIALIZED (SELECT doc_id, pos, {keywords('x')} AS k, {numbers('x')} AS n FROM (SELECT doc_id, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM i)),
        o AS (SELECT a.doc_id AS pair_id, CASE WHEN length(a.k) = 0 OR length(b.k) = 0 THEN 0.0::DOUBLE ELSE length(list_intersect(a.k, b.k))::DOUBLE / least(length(a.k), length(b.k)) END AS share, a.n AS an, b.n AS bn FROM u a JOIN u b ON b.doc_id = a.doc_id + 1)"""


def pair_overlap() -> str:
    return f"{_pairs()} SELECT a.doc_id AS pair_id, length(a.items) AS n_a, length(b.items) AS n_b, coalesce(max(share), 0.0) AS best_overlap FROM i a JOIN i b ON b.doc_id = a.doc_id + 1 LEFT JOIN o ON o.pair_id = a.doc_id GROUP BY ALL"


def pair_conflicts() -> str:
    return f"{_pairs()} SELECT a.doc_id AS pair_id, count(*) FILTER (share >= 0.5 AND length(an) > 0 AND length(bn) > 0 AND list_sort(an) <> list_sort(bn)) AS n_conflicts FROM i a JOIN i b ON b.doc_id = a.doc_id + 1 LEFT JOIN o ON o.pair_id = a.doc_id GROUP BY ALL"
