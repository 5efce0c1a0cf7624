"""Queries over the driver's tables; for the default lexicons, over its documents with sentences planted in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.functions import lexicons as lex, text as T
from vellum.operators import charts, compare, email, limits, outline, qa, review
from vellum.plans import fixtures as fx, oracle as S
from vellum.plans.registry import ORACLE_SQL, QUERIES, query
from vellum.sinks import reports
from vellum.sources.tables import read_table as table, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return docs.select("doc_id", F.concat(F.lit("From: "), "source", F.lit("\nTo: "), "lang", F.lit("\nSubject: note "), F.col("doc_id").cast("string"), F.lit("\n"), "text").alias("text"))


def neighbours(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Each document as A and the next one as B, as items."""
    side = lambda n, name: F.struct((F.col("doc_id") - n).alias("pair_id"), F.lit(name).alias("side"))
    return compare.item_sides(documents(spark, sf_dir), F.array(side(0, "a"), side(1, "b")), texts=texts)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def joined(c: Column | str, by: str = "|") -> Column:
    return F.array_join(c, by)


# text


@query(f"SELECT doc_id, length({S.norm('text')}) AS n_norm, length(text) AS n_chars FROM documents")
def normalize_length(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", long(F.length(T.collapse(F.col("text")))).alias("n_norm"), long(F.length("text")).alias("n_chars"))


@query(f"SELECT doc_id, length({S.sentences('text')}) AS n_sentences FROM documents")
def sentence_split_count(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", long(F.size(T.sentences(F.col("text")))).alias("n_sentences"))


@query(f"SELECT doc_id, pos - 1 AS pos, sentence FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))")
def sentence_rows(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", long("pos").alias("pos"), "sentence")


@query(f"WITH i AS ({S.items_of('SELECT doc_id, text FROM documents', 'doc_id')}) SELECT doc_id, length(items) AS n_items, md5(array_to_string(items, '|')) AS items_md5 FROM i")
def item_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.items(F.col("text")).alias("i")).select("doc_id", long(F.size("i")).alias("n_items"), F.md5(joined("i")).alias("items_md5"))


@query(f"""WITH s AS (SELECT doc_id, {S.sentences('text')} AS s FROM documents), u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS r FROM u)
    SELECT doc_id, count(*) AS n_kept, sum(pos)::BIGINT AS places FROM k WHERE r = 1 GROUP BY doc_id""")
def items_dedup_ci(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    kept = rows.select("doc_id", T.distinct_ci(F.col("s")).alias("d"), T.let(F.transform("s", F.lower), lambda low: F.filter(F.transform(low, lambda v, i: F.when(F.array_position(low, v) == i + 1, i + 1)), lambda x: x.isNotNull())).alias("p"))
    return kept.select("doc_id", long(F.size("d")).alias("n_kept"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query(f"SELECT doc_id, length(s) AS n_sentences, length(list_distinct(s)) AS n_distinct FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def items_dedup_exact(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", long(F.size("s")).alias("n_sentences"), long(F.size(F.array_distinct("s"))).alias("n_distinct"))


@query(f"SELECT doc_id, length(t) AS n_tokens, length(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)")
def token_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", long(F.size("t")).alias("n_tokens"), long(F.size(F.array_distinct("t"))).alias("n_distinct"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS token FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)) GROUP BY token")
def token_frequency(spark, sf_dir):
    texts = documents(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    return texts.select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, length(k) AS n_keywords, md5(array_to_string(list_sort(k), '|')) AS keywords_md5 FROM (SELECT doc_id, {S.keywords('text')} AS k FROM documents)")
def keyword_sets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.keywords(F.col("text")).alias("k")).select("doc_id", long(F.size("k")).alias("n_keywords"), F.md5(joined(F.array_sort("k"))).alias("keywords_md5"))


@query(f"SELECT doc_id, length(n) AS n_numbers, array_to_string(list_sort(n), '|') AS numbers FROM (SELECT doc_id, {S.numbers('text')} AS n FROM documents)")
def number_sets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.numbers(F.col("text")).alias("n")).select("doc_id", long(F.size("n")).alias("n_numbers"), joined(F.array_sort("n")).alias("numbers"))


@query(f"SELECT doc_id, length(text) > {lex.MAX_DOCUMENT} AS input_too_long FROM documents")
def input_limits(spark, sf_dir):
    return limits.check_limits(documents(spark, sf_dir)).select("doc_id", "input_too_long")


@query(f"SELECT doc_id, CASE WHEN length(s) = 0 THEN '' WHEN length(s[1]) <= 180 THEN s[1] ELSE regexp_replace(s[1][1:180], ' [^ ]*$', '') || '...' END AS short FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def shorten_first_sentence(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.shorten(F.coalesce(F.try_element_at(T.sentences(F.col("text")), F.lit(1)), F.lit(""))).alias("short"))


@query("SELECT doc_id, CASE WHEN length(text) > 1500 THEN text[1:1500] || '...' ELSE text END AS preview FROM documents")
def text_preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", limits.preview(F.col("text")).alias("preview"))


# review


def data_review(spark, sf_dir):
    return review.review_documents(documents(spark, sf_dir), brd=fx.DATA_SECTIONS, vague=fx.DATA_PHRASES, terms=fx.DATA_TERMS, optional="thinthe").where("review is not null")


@query(S.checklist("SELECT doc_id, text FROM documents", fx.DATA_SECTIONS))
def review_section_checklist(spark, sf_dir):
    return review.checklist_rows(documents(spark, sf_dir), fx.DATA_SECTIONS, "doc_id").select("doc_id", long("pos").alias("pos"), "section", "status", "evidence")


@query(f"SELECT doc_id, round_even(100.0 * count(*) FILTER (status = 'Detected') / count(*), 0)::BIGINT AS completeness FROM ({S.checklist('SELECT doc_id, text FROM documents', fx.DATA_SECTIONS)}) GROUP BY doc_id")
def review_completeness(spark, sf_dir):
    return data_review(spark, sf_dir).select("doc_id", long("review.completeness_indicator").alias("completeness"))


@query(f"SELECT doc_id, coalesce(string_agg(section, '|' ORDER BY pos) FILTER (status <> 'Detected'), '') AS missing, count(*) FILTER (status = 'Detected') AS n_detected FROM ({S.checklist('SELECT doc_id, text FROM documents', fx.DATA_SECTIONS)}) GROUP BY doc_id")
def review_missing_sections(spark, sf_dir):
    return data_review(spark, sf_dir).select("doc_id", joined("review.missing_sections").alias("missing"), long(F.size("review.detected_sections")).alias("n_detected"))


@query(f"SELECT doc_id, {S.found(S.norm('text'), fx.DATA_PHRASES)} AS phrases FROM documents")
def review_vague_language(spark, sf_dir):
    issues = review.vague_issues(F.lower(T.collapse(F.col("text"))), fx.DATA_PHRASES)
    return documents(spark, sf_dir).select("doc_id", joined(F.transform(issues, lambda i: F.regexp_extract(i, "detected: '(.*)'[.] Replace", 1))).alias("phrases"))


@query(f"""WITH s AS (SELECT doc_id, unnest({S.sentences('text')}) AS s FROM documents) SELECT doc_id, count(*) FILTER (contains(lower(s), 'the')) AS n_optional,
    count(*) FILTER (len(string_split(s, ' ')) < 5) AS n_short FROM s WHERE {S.any_of('lower(s)', fx.DATA_TERMS)} GROUP BY doc_id""")
def review_weak_requirements(spark, sf_dir):
    said = T.mentioning(T.sentences(F.col("text")), fx.DATA_TERMS)
    rows = documents(spark, sf_dir).select("doc_id", F.explode_outer(F.array(said)).alias("s")).where(F.size("s") > 0)  # found once: no filter is moved below an explode
    n = lambda start: long(F.size(F.filter("i", lambda x: x.startswith(start))))
    return rows.select("doc_id", review.weak_issues(F.col("s"), fx.DATA_TERMS, "the").alias("i")).select("doc_id", n("A requirement uses").alias("n_optional"), n("A requirement may be").alias("n_short"))


@query(S.planted_reviews())
def review_fixtures(spark, sf_dir):
    """Reviews by the default lexicons of all documents, each behind a planted text, by the kind that goes with it."""
    rows = review.review_documents(fx.planted(documents(spark, sf_dir)), document_type=F.col("kind"))
    r = lambda f: F.col(f"review.{f}")
    return rows.select("doc_id", "error_code", long(r("completeness_indicator")).alias("completeness"), joined(r("detected_sections")).alias("detected"), joined(r("missing_sections")).alias("missing"), F.md5(joined(r("wording_issues"))).alias("issues_md5"), joined(r("recommendations")).alias("recommendations"))


# outline


def _labels(name: str, field: str, labels: dict[str, str]) -> None:
    @query(f"SELECT doc_id, CASE WHEN {S.norm('text')} <> '' THEN coalesce(nullif({S.labels(S.norm('text'), labels)}, ''), {S.lit(lex.UNCONFIRMED)}) END AS labels FROM documents", name)
    def run(spark, sf_dir):
        rows = outline.draft_outline(documents(spark, sf_dir), stakeholders=fx.DATA_LABELS, recipients=fx.DATA_RECIPIENTS, required=fx.DATA_REQUIRED)
        return rows.select("doc_id", joined(F.col(f"outline.{field}")).alias("labels"))


_labels("brd_stakeholders", "stakeholders", fx.DATA_LABELS)
_labels("brd_recipients", "service_recipients", fx.DATA_RECIPIENTS)
_labels("brd_required_info", "required_data_and_documents", fx.DATA_REQUIRED)


def _mentioned(name: str, words: list[str]) -> None:
    @query(f"SELECT doc_id, length(m) AS n, length(list_distinct(m)) AS n_distinct, sum_len AS n_chars FROM (SELECT doc_id, m, coalesce(list_sum(list_transform(list_distinct(m), lambda x: length(x))), 0)::BIGINT AS sum_len FROM (SELECT doc_id, list_filter({S.sentences('text')}, lambda s: {S.any_of('lower(s)', words)}) AS m FROM documents))", name)
    def run(spark, sf_dir):
        rows = documents(spark, sf_dir).select("doc_id", T.mentioning(T.sentences(F.col("text")), words).alias("m")).withColumn("d", F.array_distinct("m"))
        return rows.select("doc_id", long(F.size("m")).alias("n"), long(F.size("d")).alias("n_distinct"), F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


_mentioned("brd_functional", fx.DATA_WORDS)
_mentioned("brd_rules", fx.DATA_TERMS)


@query(f"SELECT doc_id, {S.service_name('text')} AS service_name FROM ({S.planted()})")
def brd_service_name(spark, sf_dir):
    return fx.planted(documents(spark, sf_dir)).select("doc_id", F.coalesce(outline.service_name(T.collapse(F.col("text"))), F.lit(lex.UNCONFIRMED)).alias("service_name"))


@query(f"SELECT doc_id, coalesce(s[1], 'Requires confirmation') AS purpose, length(s) AS n_steps FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)")
def brd_purpose_steps(spark, sf_dir):
    rows = outline.draft_outline(documents(spark, sf_dir))
    return rows.select("doc_id", F.coalesce("outline.service_overview.service_purpose", F.lit(lex.UNCONFIRMED)).alias("purpose"), F.coalesce(long(F.size("outline.process_steps")), F.lit(0).cast("long")).alias("n_steps"))


@query(S.planted_outlines())
def brd_fixtures(spark, sf_dir):
    """Outlines by the default lexicons of all documents, each behind a planted text."""
    rows = outline.draft_outline(fx.planted(documents(spark, sf_dir)))
    o = lambda f: joined(F.col(f"outline.{f}"))
    return rows.select("doc_id", "error_code", *(o(f).alias(f) for f in ("stakeholders", "service_recipients", "required_data_and_documents")), F.md5(o("functional_requirements")).alias("functional_md5"), F.md5(o("business_rules")).alias("rules_md5"))


# mail


@query(f"SELECT doc_id, source AS sender, lang AS recipient, 'note ' || doc_id AS subject FROM documents")
def email_headers(spark, sf_dir):
    s = email.summarize_mails(mails(spark, sf_dir), fields=("sender", "recipient", "subject"))
    return s.select("doc_id", "summary.sender", "summary.recipient", "summary.subject")


@query(f"SELECT doc_id, md5({S.norm('text')}) AS body_md5 FROM documents")
def email_body(spark, sf_dir):
    return mails(spark, sf_dir).select("doc_id", F.md5(email.body_of(T.lines(F.col("text")))).alias("body_md5"))


@query(f"SELECT doc_id, CASE WHEN {S.any_of('lower(text)', fx.DATA_PHRASES[2:4])} THEN 'High' WHEN {S.any_of('lower(text)', fx.DATA_TERMS)} THEN 'Medium' ELSE 'Normal' END AS priority FROM documents")
def email_priority(spark, sf_dir):
    return mails(spark, sf_dir).select("doc_id", email.priority_of(F.lower(F.array_join(T.lines(F.col("text")), "\n")), fx.DATA_PHRASES[2:4], fx.DATA_TERMS).alias("priority"))


def _mail_items(name: str, words: list[str]) -> None:
    @query(f"WITH m AS ({S.mail_sentences('SELECT doc_id, text FROM documents')}) {S.first_items('m', words)}", name)
    def run(spark, sf_dir):
        s = T.mail_sentences(email.body_of(T.lines(F.col("text"))))
        return mails(spark, sf_dir).select("doc_id", email.first_items(T.mentioning(s, words)).alias("i")).select("doc_id", long(F.size("i")).alias("n"), F.md5(joined("i")).alias("items_md5"))


_mail_items("email_actions", fx.DATA_WORDS)
_mail_items("email_decisions", fx.DATA_TERMS)


@query(S.mail_summary("SELECT doc_id, text FROM documents", fx.DATA_TERMS))
def email_summary(spark, sf_dir):
    s = T.mail_sentences(T.let(T.lines(F.col("text")), email.body_of))
    return mails(spark, sf_dir).select("doc_id", T.let(s, lambda x: email.summary_of(x, fx.DATA_TERMS)).alias("s")).select("doc_id", long(F.size("s")).alias("n"), F.md5(joined("s")).alias("summary_md5"))


@query(S.planted_deadlines())
def email_deadlines(spark, sf_dir):
    """Which sentences name a deadline; every second one has a planted case behind it."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    case = fx.dealt(F.col("doc_id") + F.floor(F.col("pos") / 2), S.DEADLINE_CASES)
    said = F.when(F.col("pos") % 2 == 0, F.concat("s", F.lit(" "), case)).otherwise(F.col("s"))
    return rows.select("doc_id", long("pos").alias("pos"), F.size(email.deadlines_of(F.array(said))).cast("boolean").alias("is_deadline"))


@query(S.mail_report("SELECT doc_id, source, lang, text FROM documents"))
def email_text_report(spark, sf_dir):
    s = email.summarize_mails(mails(spark, sf_dir), actions=fx.DATA_WORDS, decisions=fx.DATA_TERMS, topics=[], high=fx.DATA_PHRASES[2:4], medium=fx.DATA_TERMS)
    return s.select("doc_id", reports.mail_report().alias("report")).select("doc_id", F.array_join(F.slice(F.split("report", "\n"), 1, 6), "\n").alias("head"), long(F.size(F.filter(F.split("report", "\n"), lambda x: x.startswith("- ")))).alias("n_bullets"))


# questions


@query(f"WITH p AS ({S.passages('SELECT doc_id, text FROM documents')}) SELECT doc_id, length(p) AS n_passages, md5(array_to_string(p, '|')) AS passages_md5 FROM p")
def qa_passages(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.passages(F.col("text")).alias("p")).select("doc_id", long(F.size("p")).alias("n_passages"), F.md5(joined("p")).alias("passages_md5"))


@query(S.planted_hints())
def qa_hints(spark, sf_dir):
    """The hint categories of a planted question followed by the opening of each document."""
    question = F.concat(fx.dealt(F.col("doc_id"), [q[2] for q in fx.QUESTIONS]), F.lit(" "), F.substring("text", 1, fx.OPENING))
    return documents(spark, sf_dir).select("doc_id", joined(qa.hints_of(T.tokens(T.collapse(question)))).alias("hints"))


def overlaps(spark, sf_dir):
    return qa.corpus_overlap(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir), "item_id", "text", "doc_id", "text")


@query(f"SELECT q_id, s_id, max(shared) AS best, count(*) AS n_passages FROM ({S.overlaps()}) GROUP BY q_id, s_id")
def qa_scores(spark, sf_dir):
    return overlaps(spark, sf_dir).groupBy("q_id", "s_id").agg(F.max("shared").alias("best"), F.count("*").alias("n_passages"))


@query(f"SELECT q_id, s_id, pos, terms, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY shared DESC, s_id, pos) AS rank FROM ({S.overlaps()})) WHERE rank <= 3")
def qa_top3(spark, sf_dir):
    return qa.top_passages(overlaps(spark, sf_dir)).select("q_id", "s_id", long("pos").alias("pos"), long("terms").alias("terms"), "shared", long("rank").alias("rank"))


# comparison


@query(S.pair_overlap())
def compare_keyword_overlap(spark, sf_dir):
    rows = compare.chunked(neighbours(spark, sf_dir, texts=False), "pair_id", every=True)
    found = rows.groupBy("pair_id").agg(F.max(compare.best_overlap("a_keys", "b_keys")).alias("best_overlap"), F.any_value("a_count").alias("n_a"), F.any_value("b_count").alias("n_b"))
    return found.select("pair_id", long("n_a").alias("n_a"), long("n_b").alias("n_b"), "best_overlap")


@query(S.pair_conflicts())
def compare_conflicts(spark, sf_dir):
    rows = compare.chunked(neighbours(spark, sf_dir, texts=False), "pair_id", every=True)
    return rows.groupBy("pair_id").agg(F.sum(compare.count_conflicts("a_keys", "b_keys", "a_numbers", "b_numbers")).alias("n_conflicts"))


@query()
def compare_best_match(spark, sf_dir):
    """The most similar item of the next document for each item of a document, by text and keywords."""
    return compare.compare_items(neighbours(spark, sf_dir), "pair_id").select("pair_id", "a_pos", "b_pos", "score", "class")


@query()
def compare_summary(spark, sf_dir):
    """Coverage and counts of each pair of neighbouring documents, by text and keywords."""
    return compare.pair_figures(neighbours(spark, sf_dir), "pair_id")


@query()
def compare_additional(spark, sf_dir):
    """Items of the next document that no item has chosen, by text and keywords."""
    return compare.extra_items(neighbours(spark, sf_dir), "pair_id")


# charts


@query("SELECT event_type AS category, count(*) AS value FROM events GROUP BY event_type")
def chart_category_values(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("value"))


@query("SELECT status, priority, n, n / sum(n) OVER (PARTITION BY status) AS share FROM (SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*)::DOUBLE AS n FROM orders GROUP BY ALL)")
def pie_share(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").cast("double").alias("n"))
    return charts.pie_shares(n, "status", "priority", "n")


@query("""SELECT o_custkey, o_orderkey, s::DATE AS start, e::DATE AS "end", date_diff('day', s::DATE, e::DATE) + 1 AS duration_days, row_number() OVER (PARTITION BY o_custkey ORDER BY s::DATE, o_orderkey) AS place
    FROM (SELECT o_custkey, o_orderkey, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def gantt_tasks(spark, sf_dir):
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    tasks = table(spark, sf_dir, "orders").join(last, "o_orderkey").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"), F.to_date("e").alias("end"))
    return charts.gantt_rows(tasks, "o_custkey", "o_orderkey", "start", "end").select("o_custkey", "o_orderkey", "start", "end", long("duration_days").alias("duration_days"), long("place").alias("place"))
