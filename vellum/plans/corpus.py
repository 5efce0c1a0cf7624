"""Queries whose results are whole texts, or files that are written and read again; and the join with a large lexicon."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from vellum.functions import lexicons as lex, text as T
from vellum.operators import charts, compare, email, lexicon, metrics, outline, qa, review
from vellum.plans import access, fixtures as fx, oracle as S
from vellum.plans.catalog import documents, long, mails, neighbours, table
from vellum.plans.derived import _MATCHES, EVENTS, KEYWORDS, by_id, deadline, event_charts, order_plans
from vellum.plans.registry import ORACLE_SQL, query
from vellum.sinks import pdf, png, reports
from vellum.sources import files
from vellum.sources.shared import work_folder
from vellum.sources.tables import spread

NL = "chr(10)"


def _told(values: str, instead: str, mark: str = "- ") -> str:
    """A list as lines with a mark before each, as SQL; a sentence in its place if it is empty."""
    return f"{S.lit(mark)} || CASE WHEN length({values}) = 0 THEN {S.lit(instead)} ELSE array_to_string({values}, {NL} || {S.lit(mark)}) END"


# a lexicon that is a table


@query(f"""WITH k AS MATERIALIZED (SELECT DISTINCT unnest({S.tokens('text')}) AS k FROM benchmark), d AS MATERIALIZED (SELECT doc_id, lower({S.norm('text')}) AS t FROM documents)
    SELECT doc_id, count(*) AS n, md5(string_agg(k, '|' ORDER BY k)) AS keywords_md5 FROM d JOIN k ON contains(t, k) GROUP BY doc_id""")
def lexicon_words(spark, sf_dir):
    """The words of all benchmark items that occur in each document, within words too."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("keyword"))
    found = lexicon.keyword_lists(documents(spark, sf_dir), words, "doc_id").groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("keywords"))).alias("k"))
    return found.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "|")).alias("keywords_md5"))


# whole texts

_FIRST = lambda i: f"list_filter({i}, lambda x, k: list_position(list_transform({i}, lambda y: lower(y)), lower(x)) = k)[1:5]"
_SHORT = lambda test: f"list_transform(list_filter(s, lambda x: {test}), lambda x: {S.short('x')})"
_PRIORITY = f"CASE WHEN {S.any_of('lower(text)', fx.DATA_PHRASES[2:4])} THEN 'High' WHEN {S.any_of('lower(text)', fx.DATA_TERMS)} THEN 'Medium' ELSE 'Normal' END"


@query(f"""WITH m AS ({S.mail_sentences('SELECT doc_id, text FROM documents')}),
    l AS (SELECT doc_id, list_transform(s, lambda x: {S.short('x')}) AS every, {_SHORT(S.any_of('lower(x)', fx.DATA_WORDS))} AS a, {_SHORT(S.any_of('lower(x)', fx.DATA_TERMS))} AS c, {_SHORT(deadline('x'))} AS t, {_SHORT(S.any_of('lower(x)', [*fx.DATA_WORDS, *fx.DATA_TERMS]))}[1:4] AS lead FROM m),
    f AS (SELECT doc_id, {_FIRST('a')} AS a, {_FIRST('c')} AS c, {_FIRST('t')} AS t, CASE WHEN length(lead) < 3 THEN list_concat(lead, list_filter(every, lambda x, i: NOT list_contains(lead, x) AND list_position(every, x) = i))[1:4] ELSE lead END AS s FROM l)
    SELECT doc_id, md5('Email Summary' || {NL} || {NL} || 'From: ' || source || {NL} || 'To: ' || lang || {NL} || 'Subject: note ' || doc_id || {NL} || 'Priority: ' || {_PRIORITY} || {NL} || {NL} || 'SHORT SUMMARY' || {NL} || {_told('f.s', lex.UNCONFIRMED)} || {NL} || {NL} || 'ACTION ITEMS' || {NL} || {_told('a', email.NO_ACTION)}
    || {NL} || {NL} || 'DEADLINES' || {NL} || {_told('t', email.NO_DEADLINE)} || {NL} || {NL} || 'DECISIONS' || {NL} || {_told('c', email.NO_DECISION)} || {NL} || {NL} || 'HUMAN REVIEW NOTES' || {NL} || {_told(S.strings(email.NOTES), '')}) AS report_md5 FROM documents JOIN f USING (doc_id)""")
def email_reports(spark, sf_dir):
    """The whole text report of each mail."""
    s = email.summarize_mails(mails(spark, sf_dir), actions=fx.DATA_WORDS, decisions=fx.DATA_TERMS, topics=[], high=fx.DATA_PHRASES[2:4], medium=fx.DATA_TERMS)
    return s.select("doc_id", F.md5(reports.mail_report()).alias("report_md5"))


_NAMED = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'We automate the ' || source || ' Renewal service. ' WHEN 1 THEN 'Digitalize an odd  SERVICE! Then automate a second service, we digitize the third service. ' WHEN 2 THEN 'Digitize ' || lang || ' service now. ' WHEN 3 THEN 'DIGITIZE A ' || lang || chr(10) || 'permit service and the next service. ' ELSE '' END || text AS text FROM documents"


@query(f"SELECT doc_id, {S.service_name('text')} AS service_name FROM ({_NAMED})")
def outline_service_names(spark, sf_dir):
    """What a planted sentence says is to be automated: verbs in order of priority, articles needed, up to the word service."""
    docs = table(spark, sf_dir, "documents")
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    lead = by_id(5, F.lit(""), r0=say("We automate the ", F.col("source"), " Renewal service. "), r1=F.lit("Digitalize an odd  SERVICE! Then automate a second service, we digitize the third service. "), r2=say("Digitize ", F.col("lang"), " service now. "), r3=say("DIGITIZE A ", F.col("lang"), "\npermit service and the next service. "))
    rows = outline.draft_outline(docs.select("doc_id", F.concat(lead, "text").alias("text")))
    return rows.select("doc_id", F.coalesce("outline.service_overview.service_name", F.lit(lex.UNCONFIRMED)).alias("service_name"))


# files


def _reviewed(source: str) -> str:
    """(doc_id, kind of column) of reviews with the data's lexicons: detected, missing, issues, recommendations, completeness, rows of the checklist."""
    weak = f"list_concat(CASE WHEN contains(lower(s), 'the') THEN ['A requirement uses ''the'', which may be optional or unclear: ' || s] ELSE [] END, CASE WHEN len(string_split(s, ' ')) < 5 THEN ['A requirement may be too short or incomplete: ' || s] ELSE [] END)"
    return f"""SELECT doc_id, list(section ORDER BY pos) FILTER (status = 'Detected') AS detected, coalesce(list(section ORDER BY pos) FILTER (status <> 'Detected'), []) AS missing, round_even(100.0 * count(*) FILTER (status = 'Detected') / count(*), 0)::BIGINT AS completeness,
        string_agg({NL} || section || ' | ' || status || ' | ' || trim(evidence), '' ORDER BY pos) AS checked, any_value(i) AS issues FROM ({S.checklist(source, fx.DATA_SECTIONS)}) JOIN
        (SELECT doc_id, list_concat(list_transform(list_filter({S.strings(fx.DATA_PHRASES)}, lambda p: contains(lower({S.norm('text')}), p)), lambda p: 'Vague wording detected: ''' || p || '''. Replace it with a measurable or specific statement.'),
            flatten(list_transform(list_filter({S.sentences('text')}, lambda s: {S.any_of('lower(s)', fx.DATA_TERMS)}), lambda s: {weak}))) AS i FROM ({source})) USING (doc_id) GROUP BY doc_id"""


_DOT = "• "


@query(f"""SELECT doc_id || '.docx' AS name, md5('Document Review' || {NL} || 'Section checklist' || {NL} || 'Detected sections' || {NL} || {_told('coalesce(detected, [])', 'None detected', _DOT)} || {NL} || 'Missing sections' || {NL} || {_told('missing', 'None detected', _DOT)}
    || {NL} || 'Wording issues' || {NL} || {_told('issues', review.NO_ISSUES, _DOT)} || {NL} || 'Recommendations' || {NL} || {_told("list_transform(missing, lambda s: 'Add or clarify the ''' || s || ''' section.')", review.NO_GAPS, _DOT)} || {NL} || 'Human review notes' || {NL} || {_told(S.strings(review.NOTES), '', _DOT)}
    || {NL} || 'Source | ' || source || {NL} || 'Document type | BRD' || {NL} || 'Mode | Rule-based' || {NL} || 'Completeness | ' || completeness || '%' || {NL} || 'Section | Status | Evidence' || checked) AS text_md5 FROM documents JOIN ({_reviewed('SELECT doc_id, text FROM documents')}) USING (doc_id)""")
def review_report_files(spark, sf_dir):
    """Word reports of the reviews of all documents: written by tasks as files, read again as a data source."""
    access.register_sources(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    done = review.review_documents(docs, brd=fx.DATA_SECTIONS, vague=fx.DATA_PHRASES, terms=fx.DATA_TERMS, optional="the").where("review is not null")
    folder = work_folder(spark, "reports")
    done.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), "source", "review").write.format("vellum_reports").option("folders", "true").option("report", "review").mode("append").save(folder)
    return spark.read.format("vellum_files").load(folder).select("name", F.md5("text").alias("text_md5"))


_LISTED = lambda labels: f"{S.lit(_DOT)} || replace(coalesce(nullif({S.labels('t', labels)}, ''), {S.lit(lex.UNCONFIRMED)}), '|', {NL} || {S.lit(_DOT)})"
_SAYING = lambda words: _told(f"list_filter(s, lambda x, i: {S.any_of('lower(x)', words)} AND list_position(s, x) = i)", lex.UNCONFIRMED, _DOT)
_UNSURE = S.lit(_DOT + lex.UNCONFIRMED)
_OUTLINED = {
    "Stakeholders": _LISTED(fx.DATA_LABELS), "Service Recipients": _LISTED(fx.DATA_RECIPIENTS), "Functional Requirements": _SAYING(fx.DATA_WORDS), "Non Functional Requirements": _UNSURE, "Business Rules": _SAYING(fx.DATA_TERMS),
    "Process Steps": f"array_to_string(list_transform(s, lambda x, i: i || '. ' || x), {NL})", "Required Data And Documents": _LISTED(fx.DATA_REQUIRED), "Integration Requirements": _UNSURE,
    "Missing Information": _told(S.strings(outline.OPEN_POINTS), "", _DOT), "Human Review Notes": _told(S.strings(outline.NOTES), "", _DOT),
}


@query(f"""SELECT doc_id || '.docx' AS name, md5('Business Requirements Document' || {NL} || 'Source: ' || source || {NL} || 'Preliminary; human review is required.' || {NL} || {f' || {NL} || '.join(f"'{i}. {k}' || {NL} || {v}" for i, (k, v) in enumerate(_OUTLINED.items(), 2))}
    || {NL} || 'Service name | ' || {S.service_name('t')} || {NL} || 'Service purpose | ' || s[1] || {NL} || 'Service scope | ' || {S.lit(lex.UNCONFIRMED)}) AS text_md5 FROM (SELECT doc_id, source, {S.norm('text')} AS t, {S.sentences('text')} AS s FROM documents) WHERE t <> ''""")
def outline_report_files(spark, sf_dir):
    """Word reports of the outlines of all documents, written by tasks and read again."""
    access.register_sources(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    done = outline.draft_outline(docs, functional=fx.DATA_WORDS, rules=fx.DATA_TERMS, stakeholders=fx.DATA_LABELS, recipients=fx.DATA_RECIPIENTS, required=fx.DATA_REQUIRED).where("outline is not null")
    folder = work_folder(spark, "outlines")
    done.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"), "source", "outline").write.format("vellum_reports").option("folders", "true").option("report", "outline").mode("append").save(folder)
    return spark.read.format("vellum_files").load(folder).select("name", F.md5("text").alias("text_md5"))


def _tables(name: str, kind: str, *more: str) -> str:
    said = "".join(f" || {NL} || {S.lit(m)}" for m in more)
    return f"coalesce(string_agg({NL} || '{name} ' || r || ' | ' || printf('%.0f', score * 100) || '%' || {NL} || 'A | ' || ax || {NL} || 'B | ' || bx{said}, '' ORDER BY ap) FILTER (class = '{kind}'), '') AS {kind}_told"


_NONE = lambda n, title: f"{NL} || '{title}' || CASE WHEN {n} = 0 THEN {NL} || 'None detected' ELSE '' END"


@query(f"""{_MATCHES}, w AS (SELECT pair_id, class, ap, a.items[ap] AS ax, b.items[bp] AS bx, printf('%.2f', share)::DOUBLE AS score, len(a.items) AS na, len(b.items) AS nb, row_number() OVER (PARTITION BY pair_id, class ORDER BY ap) AS r FROM c JOIN i a ON a.doc_id = pair_id JOIN i b ON b.doc_id = pair_id + 1),
    g AS (SELECT pair_id, any_value(na) AS na, any_value(nb) AS nb, count(*) FILTER (class = 'matched') AS matched, count(*) FILTER (class = 'partial') AS partial, count(*) FILTER (class = 'missing') AS missing, count(*) FILTER (class = 'conflict') AS conflict, coalesce(list(ax ORDER BY ap) FILTER (class = 'missing'), []) AS lacking,
        {_tables('Match', 'matched')}, {_tables('Partial match', 'partial', 'review_note | ' + compare.RELATED)}, {_tables('Conflict', 'conflict', 'reason | ' + compare.CONFLICT)} FROM w GROUP BY pair_id),
    e AS (SELECT v.doc_id - 1 AS pair_id, list(v.x ORDER BY v.pos) AS extra FROM (SELECT doc_id, unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM i) v LEFT JOIN (SELECT DISTINCT pair_id + 1 AS doc_id, bp AS pos FROM c WHERE class <> 'missing') q USING (doc_id, pos) WHERE q.pos IS NULL GROUP BY ALL)
    SELECT pair_id || '.docx' AS name, md5('Document Comparison' || {NL} || 'Summary' || {_NONE('matched', 'Matched items')} || {_NONE('partial', 'Partial matches')} || {_NONE('conflict', 'Possible conflicts')} || {_NONE('missing', 'Missing in document b')} || CASE WHEN missing > 0 THEN {NL} || {_told('lacking', '', _DOT)} ELSE '' END
    || {_NONE('coalesce(len(extra), 0)', 'Additional in document b')} || CASE WHEN len(extra) > 0 THEN {NL} || {_told('extra', '', _DOT)} ELSE '' END || {NL} || 'Notes' || {NL} || {_told(S.strings(compare.NOTES), '', _DOT)} || {NL} || 'Document A | Document ' || pair_id || {NL} || 'Document B | Document ' || (pair_id + 1)
    || {NL} || 'Items in A | ' || na || {NL} || 'Items in B | ' || nb || {NL} || 'Coverage | ' || round_even(100.0 * (matched + partial + conflict) / na, 0)::BIGINT || '%' || {NL} || 'Matched count | ' || matched || {NL} || 'Partial match count | ' || partial || {NL} || 'Missing count | ' || missing || {NL} || 'Additional count | ' || coalesce(len(extra), 0)
    || {NL} || 'Possible conflict count | ' || conflict || matched_told || partial_told || conflict_told) AS text_md5 FROM g LEFT JOIN e USING (pair_id)""")
def comparison_report_files(spark, sf_dir):
    """Word reports of all pairs of neighbouring documents compared by keywords, written by tasks and read again."""
    access.register_sources(spark)
    name = lambda n: F.concat(F.lit("Document "), (F.col("pair_id") + n).cast("string"))
    done = compare.pair_comparisons(neighbours(spark, sf_dir), "pair_id", a_name=name(0), b_name=name(1), **KEYWORDS).where("comparison is not null")
    folder = work_folder(spark, "comparisons")
    done.select(F.concat(F.col("pair_id").cast("string"), F.lit(".docx")).alias("name"), "comparison").write.format("vellum_reports").option("folders", "true").option("report", "comparison").mode("append").save(folder)
    return spark.read.format("vellum_files").load(folder).select("name", F.md5("text").alias("text_md5"))


@query(f"""SELECT doc_id || '.txt' AS name, strlen(text) AS bytes, CASE WHEN trim(text, chr(32) || chr(10)) = '' THEN 'NO_TEXT' END AS error_code, md5(nullif(trim(text, chr(32) || chr(10)), '')) AS text_md5 FROM documents WHERE doc_id % 3 = 0""")
def source_files(spark, sf_dir):
    """Text files written by tasks, among files of another kind, and read again: the filter on the kind leaves those out before a task is made."""
    access.register_sources(spark)
    folder = work_folder(spark, "files")
    kind = F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".md")
    documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), kind).alias("name"), F.col("text").alias("result")).write.format("vellum_reports").option("folders", "true").option("report", "text").mode("append").save(folder)
    return spark.read.format("vellum_files").load(folder).where("kind = 'txt'").select("name", "bytes", "error_code", F.md5("text").alias("text_md5"))


_GAPS = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"


@F.arrow_udf(BinaryType())
def _pdf(text: pa.Array, form: pa.Array) -> pa.Array:
    return pa.array([pdf.text_pdf(t, bool(n & 1), bool(n & 2), bool(n & 4)) for t, n in zip(text.to_pylist(), form.to_pylist(), strict=True)], pa.binary())


@query(f"""WITH l AS (SELECT doc_id, x, i FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(CASE WHEN doc_id // 2 % 2 = 1 THEN text ELSE regexp_replace(text, '[^ -~\n]', '', 'g') END, {NL}), lambda x: trim(x, {_GAPS}) <> '') AS ls FROM documents))),
    p AS (SELECT doc_id, i // {pdf.LINES} + 1 AS p, trim(string_agg(rtrim(x, {_GAPS}), {NL} ORDER BY i), {_GAPS}) AS t FROM l GROUP BY ALL), t AS (SELECT doc_id, string_agg('--- Page ' || p || ' ---' || {NL} || t, {NL} || {NL} ORDER BY p) AS t FROM p GROUP BY doc_id)
    SELECT 'in/' || doc_id || '.pdf' AS path, CASE WHEN t IS NULL THEN 'NO_TEXT' END AS error_code, md5(t) AS text_md5 FROM documents LEFT JOIN t USING (doc_id)""")
def source_pdf(spark, sf_dir):
    """PDF files of all documents, read again: with a table of objects or streams of them, Latin or composite fonts, encrypted or not."""
    text = F.when(F.floor(F.col("doc_id") / 2) % 2 == 1, F.col("text")).otherwise(F.regexp_replace("text", r"[^ -~\n]", ""))
    given = documents(spark, sf_dir).select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), _pdf(text, (F.col("doc_id") % 8).cast("int")).alias("content"))
    return files.documents_of(given).select("path", "error_code", F.md5("text").alias("text_md5"))


# figures


def _sums(task: str, of: str, results: str, **figures: str) -> str:
    every = {"results": f"count(*) FILTER ({results})", "errors": f"count(*) FILTER (NOT ({results}))", **{k: f"coalesce(sum({v}), 0)" for k, v in figures.items()}}
    return " UNION ALL ".join(f"SELECT '{task}' AS task, '{k}' AS figure, ({v})::BIGINT AS value FROM ({of})" for k, v in every.items())


_SQL = ORACLE_SQL
_REVIEWED_ALL = f"SELECT d.doc_id, c.completeness, m.n FROM documents d LEFT JOIN ({_SQL['review_completeness']}) c USING (doc_id) LEFT JOIN (SELECT doc_id, {len(fx.DATA_SECTIONS)} - n_detected AS n FROM ({_SQL['review_missing_sections']})) m USING (doc_id)"
_ASKED_ALL = f"SELECT d.doc_id, a.ok, a.score FROM documents d LEFT JOIN ({_SQL['qa_document_answers']}) a USING (doc_id)"

_OUTLINED_ALL = f"SELECT doc_id, n_distinct, n_steps FROM ({_SQL['brd_functional']}) JOIN ({_SQL['brd_purpose_steps']}) USING (doc_id)"
_SUMMARISED_ALL = f"""SELECT doc_id, s.n, a.n AS actions, d.n AS deadlines FROM ({S.mail_summary('SELECT doc_id, text FROM documents', [*fx.DATA_WORDS, *fx.DATA_TERMS])}) s JOIN ({_SQL['email_actions']}) a USING (doc_id)
    JOIN (SELECT doc_id, length({_FIRST('t')}) AS n FROM (SELECT doc_id, {_SHORT(deadline('x'))} AS t FROM ({S.mail_sentences('SELECT doc_id, text FROM documents')}))) d USING (doc_id)"""


@query(" UNION ALL ".join((
    _sums("outline", _OUTLINED_ALL, "n_steps > 0", functional_requirements="CASE WHEN n_steps > 0 THEN greatest(n_distinct, 1) END", process_steps="n_steps"),
    _sums("summary", _SUMMARISED_ALL, "TRUE", summary_bullets="n", action_items="greatest(actions, 1)", deadlines="deadlines"),
    _sums("review", _REVIEWED_ALL, "completeness IS NOT NULL", completeness="completeness", missing_sections="n"),
    _sums("comparison", _SQL["compare_figures"], "error_code IS NULL", coverage="coverage", matched="matched", missing="missing", conflict="conflict"),
    _sums("answer", _ASKED_ALL, "ok IS NOT NULL", supported="ok::INT", high_confidence="(score >= 0.65)::INT"),
    _sums("chart", _SQL["chart_rules"], "error_code IS NULL", rows="n_rows"))))
def task_metrics(spark, sf_dir):
    """The figures of all six tasks in sum, told by the jobs that made the results."""
    docs = documents(spark, sf_dir)
    asked = qa.answer_questions(docs.withColumn("question", F.substring(T.collapse(F.col("text")), 20, 101)), "text", "question", fx.DATA_HINTS)
    pairs = compare.pair_figures(neighbours(spark, sf_dir, texts=False), "pair_id", **KEYWORDS)
    drafted = outline.draft_outline(docs, functional=fx.DATA_WORDS)
    told_mails = email.summarize_mails(mails(spark, sf_dir), actions=fx.DATA_WORDS, decisions=fx.DATA_TERMS, topics=[], fields=("summary_bullets", "action_items", "deadlines"))
    jobs = {
        "outline": (drafted, metrics.figures("outline")), "summary": (told_mails, metrics.figures("summary")),
        "review": (review.review_documents(docs, brd=fx.DATA_SECTIONS, vague=fx.DATA_PHRASES, terms=fx.DATA_TERMS), metrics.figures("review")),
        "comparison": (pairs, {c: F.col(c) for c in ("coverage", "matched", "missing", "conflict")}),
        "answer": (asked, metrics.figures("answer")), "chart": (charts.chart_data(event_charts(spark, sf_dir)), metrics.figures("chart")),
    }
    told = []
    for task, (rows, shown) in jobs.items():
        kept, seen = metrics.observed(rows, shown)
        kept.write.format("noop").mode("overwrite").save()
        told += [(task, k, v) for k, v in seen.get.items()]
    return spark.createDataFrame(told, "task string, figure string, value long")


# table functions


@query(f"""SELECT doc_id, (i + 1)::INT AS row_number, e[i] AS "Type", CASE WHEN k = 2 AND i = len(v) THEN NULL WHEN k = 1 AND i = 1 THEN (1000 + v[i])::DOUBLE WHEN k = 6 AND i = 1 THEN -v[i]::DOUBLE WHEN k = 8 THEN 0 ELSE v[i]::DOUBLE END AS "Count"
    FROM (SELECT doc_id, k, v, e, unnest(range(1, len(v) + 1)) AS i FROM ({EVENTS}) WHERE k NOT IN (3, 4, 5, 11))""")
def chart_table(spark, sf_dir):
    """Chart tables of one header as a table with its names and types, by a function whose schema comes from its arguments."""
    access.register_functions(spark)
    return spark.sql("SELECT * FROM chart_table(TABLE({tables}), ' Type ,Count', 'Bar Chart')", tables=event_charts(spark, sf_dir).select("doc_id", "data_text"))


# pictures


#: Pictures that are held at once.
PICTURES = 64


def _seen(body: bytes) -> tuple[int, int, int]:
    """Width, height and number of colours of a picture, read from its bytes."""
    width, height, depth, kind = struct.unpack(">IIBB", body[16:26])
    if (depth, kind) != (4, 3):
        raise ValueError("not two numbers of colours to a byte")
    parts, at = [], 8
    while at < len(body):
        size, name = struct.unpack(">I4s", body[at : at + 8])
        parts += [body[at + 8 : at + 8 + size]] if name == b"IDAT" else []
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, -1)[:, 1:]
    two = np.zeros(256, bool)
    two[lines[:1]] = True
    two[lines[1:][(lines[1:] != lines[:-1]).any(axis=1)]] = True  # a line that is as the one above shows nothing new
    found = np.flatnonzero(two)
    return width, height, len({*(found >> 4).tolist(), *((found & 15).tolist() if width > 1 else ())})


def _pictured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Draws charts and reads the pictures, a few at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PICTURES):
            part = batch.slice(lo, PICTURES)
            seen = [_seen(png.chart_png(c)) for c in part.column("chart").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*seen, strict=True))], ["doc_id", "width", "height", "colours"])


@query(f"""SELECT doc_id, 1800::BIGINT AS width, floor(greatest(5.5::DOUBLE, n_tasks * 0.55::DOUBLE + 2) * 180)::BIGINT AS height, TRUE AS drawn FROM ({_SQL['gantt_rules']}) WHERE error_code IS NULL
    UNION ALL SELECT doc_id, 1800, 1080, TRUE FROM ({_SQL['chart_rules']}) WHERE error_code IS NULL""")
def chart_pictures(spark, sf_dir):
    """Pictures of all valid charts and plans: their size, and that more than the ground is drawn."""
    both = [charts.chart_data(f(spark, sf_dir)).where("error_code is null").select("doc_id", "chart") for f in (order_plans, event_charts)]
    rows = [b.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(_pictured, f"doc_id {b.schema['doc_id'].dataType.simpleString()}, width long, height long, colours long") for b in both]
    return rows[0].unionByName(rows[1]).select("doc_id", "width", "height", (F.col("colours") > 2).alias("drawn"))
