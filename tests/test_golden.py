"""Golden rows, derived by hand from the rules."""

import io
import json
import zipfile
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests import goldens
from vellum.operators import charts, compare, email, limits, outline, qa, review
from vellum.plans import fixtures as fx
from vellum.sinks import png, reports, word
from vellum.sources import files
from vellum.streaming import apply

# The inputs that the expected results are stated for.
OUTLINE = "A government entity wants to automate licence renewal. Applicants provide a national identification number and proof of payment. An employee reviews each application. Approved applicants receive a digital licence."
REVIEW = (
    "Service Overview: The service automates licence renewal. Stakeholders: applicants and licensing employees. Service Recipients: citizens holding an existing licence. "
    "Functional Requirements: Applicants submit an identification number and proof of payment. Required Data and Documents: identification number and payment receipt. An employee should review requests quickly."
)
A = "Applicants must provide an identification number. Approved applications receive a digital licence within 5 days. The system must notify rejected applicants."
B = "The applicant shall submit an identification number. Approved requests receive a digital licence within 7 days. The system shall record every completed transaction."
MAIL = (
    "From: Ahmad Saleh\nTo: Project Team\nSubject: Urgent review of the service document\nPlease review the attached service requirements and send your comments by tomorrow. "
    "The team agreed to finalize the document after receiving all comments. Kindly confirm that the integration section is complete."
)
SOURCE = "Licence renewal requires a valid national identification card and proof of payment. The service fee is 20 JOD. Processing normally takes three working days."
BAR = "Department,Requests\nLicensing,120\nPayments,85\nSupport,60"
GANTT = "Task,Start,End\nRequirements,2026-08-01,2026-08-05\nDevelopment,2026-08-06,2026-08-15\nTesting,2026-08-16,2026-08-20"


def one(spark, values, schema, operator, column):
    return operator(spark.createDataFrame([values], schema)).first()[column]


def test_outline(spark):
    o = one(spark, (OUTLINE,), "text string", outline.draft_outline, "outline")
    s = [x if x.endswith(".") else x + "." for x in OUTLINE.split(". ")]
    assert (o.service_overview.service_name, o.service_overview.service_purpose, o.process_steps) == ("Requires confirmation", s[0], s)
    assert o.stakeholders == ["Applicant", "Authorized employee", "Government entity"] and o.service_recipients == ["Applicant", "Government entity"]
    assert o.functional_requirements == s[1:] and o.business_rules == [s[3]]
    assert o.required_data_and_documents == ["Identification number", "Proof of payment"]
    assert word.outline_report(o.asDict(True), "test")[:2] == b"PK"


def test_review(spark):
    r = one(spark, (REVIEW,), "text string", review.review_documents, "review")
    assert r.completeness_indicator == 44 and r.detected_sections == ["Stakeholders", "Service Recipients", "Functional Requirements", "Required Data and Documents"]
    evidence = {c.section: c.evidence for c in r.section_checklist}
    assert evidence["Stakeholders"] == ["stakeholder", "applicant", "employee"] and evidence["Service Overview"] == []
    assert evidence["Functional Requirements"] == ["functional requirement", "submit", "review"] and evidence["Required Data and Documents"] == ["required data", "identification number", "proof"]
    assert len(r.wording_issues) == 2 and "'quickly'" in r.wording_issues[0] and "'should'" in r.wording_issues[1] and len(r.recommendations) == 5
    assert "document.xml" in str(zipfile.ZipFile(io.BytesIO(word.review_report(r.asDict(True), "x"))).namelist())


def test_comparison(spark):
    row = compare.compare_documents(spark.createDataFrame([(A, B, "BRD", "SRS")], "a_text string, b_text string, a_name string, b_name string")).first()
    assert [(m.score, m["class"], m.b_pos) for m in row.matches] == [(0.68, "partial", 0), (0.85, "conflict", 1), (0.34, "missing", 2)]
    c = row.comparison
    assert (c.coverage_indicator, tuple(c.summary)) == (67, (0, 1, 1, 1, 1)) and c.additional_in_document_b == ["The system shall record every completed transaction."]
    assert word.comparison_report(c.asDict(True))[:2] == b"PK"


def test_mail(spark):
    s = one(spark, (MAIL,), "text string", email.summarize_mails, "summary")
    body = [x if x.endswith(".") else x + "." for x in MAIL.split("\n")[3].split(". ")]
    assert (s.sender, s.recipient, s.subject, s.priority) == ("Ahmad Saleh", "Project Team", "Urgent review of the service document", "High")
    assert (s.summary_bullets, s.action_items, s.deadlines, s.decisions) == (body, [body[0], body[2]], [body[0]], [body[1]])


@pytest.mark.parametrize(("question", "status", "confidence", "n"), [("What documents are required for licence renewal?", qa.FOUND, "High", 1), ("Can I receive the licence by home delivery?", qa.NOT_FOUND, "Low", 0)])
def test_answers(spark, question, status, confidence, n):
    a = one(spark, (SOURCE, question), "source_text string, question string", qa.answer_questions, "answer")
    assert (a.answer_status, a.confidence_indicator, len(a.supporting_passages)) == (status, confidence, n)
    if n:
        assert (a.supporting_passages[0].relevance_score, a.supporting_passages[0].shared_terms) == (0.66, ["licence", "renewal"])


def test_charts(spark):
    rows = spark.createDataFrame([(1, "Bar Chart", BAR, "", "", ""), (2, "Gantt Chart", GANTT, "", "", ""), (3, "Pie Chart", BAR, "", "", ""), (4, "Line Chart", BAR, "", "", "")], "id long, chart_type string, data_text string, title string, x_label string, y_label string")
    found = {r.id: r.chart for r in charts.chart_data(rows).collect()}
    assert [(p.category, p.value) for p in found[1].points] == [("Licensing", 120.0), ("Payments", 85.0), ("Support", 60.0)] and found[1].title == "Requests by Department"
    assert [t.duration_days for t in found[2].tasks] == [5, 10, 5] and found[2].title == "Project Gantt Chart"
    for c in found.values():
        image = png.chart_png(c.asDict(True))
        assert image.startswith(b"\x89PNG\r\n\x1a\n") and zlib.decompress(image[image.index(b"IDAT") + 4 : image.index(b"IEND") - 8])
    shares = charts.pie_shares(spark.createDataFrame([(1, "a", 120.0), (1, "b", 85.0), (1, "c", 60.0)], "chart long, category string, value double"), "chart", "category", "value")
    assert [round(100 * r.share, 1) for r in shares.orderBy("category").collect()] == [45.3, 32.1, 22.6]


def test_pictures_show_what_charts_say(spark):
    """Titles, axes, names, values and percentages are drawn where the picture says, bars and slices in their size."""
    rows = spark.createDataFrame([(1, "Bar Chart", BAR), (2, "Gantt Chart", GANTT), (3, "Pie Chart", BAR), (4, "Line Chart", "Jour,É\na,-2\nb,2.5")], "id long, chart_type string, data_text string").selectExpr("*", "'' AS title", "'' AS x_label", "'' AS y_label")
    found = {r.id: r.chart.asDict(True) for r in charts.chart_data(rows).collect()}
    texts = {1: ["Requests by Department", "Department", "Requests", "Licensing", "Payments", "Support", "0", "120"], 2: ["Project Gantt Chart", "Requirements", "2026-08-01", "Testing"], 3: ["Requests by Department", "45.3%", "32.1%", "22.6%", "Support"], 4: ["É by Jour", "É", "Jour", "-2", "2.50", "a", "b"]}
    for i, chart in found.items():
        canvas = png.draw(chart)
        assert set(texts[i]) <= {x.text for x in canvas.labels}
        for x in canvas.labels:
            m = x.mask()
            y0, x0 = max(0, x.y - m.shape[0] // 2), max(0, x.x - m.shape[1] // 2)
            part = canvas.image[y0 : y0 + m.shape[0], x0 : x0 + m.shape[1]]
            assert (part[m[: part.shape[0], : part.shape[1]]] == png.INK).mean() > 0.9, x.text
    canvas = png.draw(found[1])
    blue = (canvas.image == png.COLOURS[0]).all(axis=2)
    heights = [blue[:, int(canvas.left + (canvas.right - canvas.left) * (i + 0.5) / 3)].sum() for i in range(3)]
    assert [round(h / heights[0], 2) for h in heights] == [1.0, round(85 / 120, 2), 0.5]
    pie = png.draw(found[3]).image
    parts = [int((pie == png.COLOURS[i]).all(axis=2).sum()) for i in range(3)]
    assert all(abs(n / sum(parts) - v / 265) < 0.01 for n, v in zip(parts, (120, 85, 60)))
    assert (pie[int(pie.shape[0] * 0.3), pie.shape[1] // 2 - 20] == png.COLOURS[0]).all()


def test_limits(spark):
    df = spark.createDataFrame([(1, "x" * 50_000, "q"), (2, "x" * 50_001, "q"), (3, "x", "q" * 1001), (4, None, None)], "id long, text string, question string")
    assert [r.input_too_long for r in limits.check_limits(df, question="question").orderBy("id").collect()] == [False, True, True, False]
    assert limits.run_gate(df, True).count() == 3 and limits.run_gate(df, False).count() == 0


def test_word_round_trip_and_readers(spark, tmp_path):
    body = word.Report("Title").bullets(["one & two", "<three>"]).table([("a", "b"), ("", "c")]).save()
    (tmp_path / "x.docx").write_bytes(body)
    (tmp_path / "y.txt").write_bytes("  text\r\n".encode())
    (tmp_path / "z.pdf").write_bytes(b"%PDF-")
    found = {r["name"]: r for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert found["x.docx"]["text"] == "Title\n• one & two\n• <three>\na | b\nc" and found["y.txt"]["text"] == "text"
    assert found["z.pdf"]["error_code"] in ("BAD_FILE", "NO_TEXT")
    chart = files.chart_texts_of(spark.createDataFrame([("a", b"\xef\xbb\xbfA,B"), ("b", b"\xff")], "path string, content binary")).orderBy("path").collect()
    assert [(r.data_text, r.error_code) for r in chart] == [("A,B", None), (None, "BAD_FILE")]


def test_json(spark, tmp_path):
    r = review.review_documents(spark.createDataFrame([(REVIEW,)], "text string"))
    assert json.loads(reports.pretty_json(r.first()["review"]))["completeness_indicator"] == 44
    reports.write_json(r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


@pytest.mark.parametrize("operator", [email.summarize_mails, review.review_documents, outline.draft_outline])
def test_streams_equal_batches(spark, sf_dir, tmp_path, operator):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows.write.parquet(str(tmp_path / "in"))
    stream = apply.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    apply.run_available(stream, operator, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, operator(rows).collect()))


def bars(column):
    return F.array_join(column, "|")


def test_golden_mails(spark):
    s = email.summarize_mails(fx.frame(spark, fx.MAILS, "mail_id long, text string"))
    f = lambda c: F.when(F.col("error_code").isNull(), bars(F.col(f"summary.{c}")))
    got = s.select("mail_id", "error_code", "summary.sender", "summary.recipient", "summary.subject", "summary.priority", f("summary_bullets"), f("action_items"), f("deadlines"), f("decisions"))
    assert sorted(map(tuple, got.collect())) == goldens.MAIL_GOLDEN


def test_golden_answers(spark):
    a = qa.answer_questions(fx.frame(spark, fx.QUESTIONS, "qa_id long, source_text string, question string"))
    top = F.try_element_at("answer.supporting_passages", F.lit(1))
    got = a.select("qa_id", "error_code", "answer.answer_status", "answer.confidence_indicator", F.rint(top["relevance_score"] * 100).cast("int"), F.size("answer.supporting_passages"), bars(top["shared_terms"])).collect()
    assert sorted(map(tuple, got)) == [(*r[:5], None if r[1] else r[5], r[6]) for r in goldens.QA_GOLDEN]
    report = a.where("error_code is null").select("qa_id", F.split(reports.answer_report(), "\n").alias("r")).collect()
    assert sorted((r.qa_id, "\n".join(r.r[2:12])) for r in report) == goldens.QA_REPORT_GOLDEN


def test_golden_pairs(spark):
    rows = compare.compare_documents(fx.frame(spark, fx.PAIRS, "pair_id long, a_text string, b_text string").withColumn("a_name", F.lit("A")).withColumn("b_name", F.lit("B")))
    got = rows.select("pair_id", "error_code", F.when(F.col("error_code").isNull(), bars(F.transform("matches", lambda m: m["class"]))), "comparison.coverage_indicator", "comparison.summary.additional_count").collect()
    assert sorted(map(tuple, got)) == goldens.PAIR_GOLDEN


@pytest.mark.parametrize("chunk", [1, 2, 32])
def test_items_in_chunks_are_compared_alike(spark, chunk):
    pairs = fx.frame(spark, [*fx.PAIRS, (9, A, B)], "pair_id long, a_text string, b_text string").selectExpr("*", "'A' AS a_name", "'B' AS b_name")
    whole = compare.compare_documents(pairs).where("error_code is null").select("pair_id", F.explode_outer("matches").alias("m")).select("pair_id", "m.a_pos", "m.a_item", "m.b_pos", "m.b_item", "m.score", "m.class")
    assert sorted(map(tuple, compare.compare_items(pairs, "pair_id", chunk=chunk).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("weights", [{}, {"text_weight": 0.0, "keyword_weight": 1.0}])
def test_comparisons_gathered_from_chunks(spark, monkeypatch, weights):
    """Documents longer than a row of items, blank ones, ones without items: the same results as of one row a pair."""
    many = " ".join(f"Number {i} of the rules holds for item {i % 7}." for i in range(90))
    pairs = fx.frame(spark, [*fx.PAIRS, (9, A, B), (10, many, many.replace("holds for", "binds the")), (11, A, many)], "pair_id long, a_text string, b_text string")
    whole = compare.compare_documents(pairs.selectExpr("*", "concat('A', pair_id) AS a_name", "cast(null as string) AS b_name"), **weights)
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_text").alias("text")), F.struct(F.lit("b").alias("side"), F.col("b_text").alias("text")))).alias("d")).select("d.text", F.array(F.struct("pair_id", "d.side")).alias("sides"))
    dealt = compare.pair_comparisons(compare.item_sides(sides, F.col("sides")), "pair_id", a_name=F.concat(F.lit("A"), "pair_id"), b_name=F.lit(None).cast("string"), **weights)
    shown = lambda df: sorted(map(str, df.select("pair_id", "error_code", "error_message", "comparison").collect()))
    assert shown(dealt) == shown(whole) and dealt.count() == len(fx.PAIRS) + 3


def test_golden_charts(spark):
    rows = fx.frame(spark, fx.CHARTS, "chart_id long, chart_type string, data_text string, title string").withColumn("x_label", F.lit("")).withColumn("y_label", F.lit(""))
    c = charts.chart_data(rows)
    points = F.transform("chart.points", lambda p: F.concat(p["category"], F.lit("="), p["value"].cast("long").cast("string")))
    tasks = F.transform("chart.tasks", lambda t: F.concat(t["task"], F.lit("="), t["duration_days"].cast("string")))
    got = c.select("chart_id", "error_code", "chart.row_count", "chart.title", bars(F.coalesce(points, tasks))).collect()
    assert sorted(map(tuple, got)) == goldens.CHART_GOLDEN


def test_charts_of_long_fields_and_null_keys(spark):
    """A field over the parser's usual limit is read, a table that it cannot read is an error of its row."""
    rows = spark.createDataFrame([(1, "Bar Chart", f"A,B\n{'x' * 200_000},1"), (2, "Bar Chart", "A,B\nx,\x001"), (3, "Bar Chart", "A,B\nx,1\ry,2")], "id long, chart_type string, data_text string").selectExpr("*", "'' AS title", "'' AS x_label", "'' AS y_label")
    got = {r.id: r for r in charts.chart_data(rows).collect()}
    assert len(got[1].chart.points[0].category) == 200_000 and all(got[i].error_code or got[i].chart for i in (2, 3))
    shares = charts.pie_shares(spark.createDataFrame([(None, "a", 1.0), (None, "b", 3.0), (1, "c", 2.0)], "chart long, category string, value double"), "chart", "category", "value")
    assert sorted((r.category, r.share) for r in shares.collect()) == [("a", 0.25), ("b", 0.75), ("c", 1.0)]


def test_merged_cells_and_one_pass_over_files(spark):
    body = '<w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {word.MAIN}><w:body>{body}</w:body></w:document>")
    df = files.documents_of(spark.createDataFrame([("a.docx", out.getvalue()), ("b.txt", b"x")], "path string, content binary"))
    assert {r.path: r.text for r in df.collect()} == {"a.docx": "one\nwide | wide | c", "b.txt": "x"}
    assert "Union" not in df._jdf.queryExecution().toString()


def pdf_file(pages, flate=False, unicode_map=False):
    """A small PDF: each page a list of lines."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [ %s ] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))))}
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    if unicode_map:
        objects[3] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"
        cmap = b"1 beginbfchar <0001> <0639> endbfchar\n2 beginbfrange <0020> <007e> <0020>\n<0100> <0101> [<00e9> <4e2d>] endbfrange"
        objects[4] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    for i, lines in enumerate(pages):
        shown = b" T*\n".join(b"[<" + x.hex().encode() + b">] TJ" if unicode_map else b"(" + x + b") Tj" for x in lines)
        body = b"BT /F1 12 Tf 72 700 Td 14 TL\n" + shown + b"\nET"
        packed = zlib.compress(body) if flate else body
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), b" /Filter /FlateDecode" if flate else b"", packed)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>"


def test_pdf_pages(spark):
    """Pages under their numbers, empty ones left out but counted; escapes, Latin letters, maps to Unicode; files that cannot be read."""
    plain = [[b"First line", rb"a \(b\) \\ \101 \351t\351"], [], [b"Third page"]]
    mapped = [[b"\x00\x01\x00 \x01\x00\x01\x01\x00A"]]
    files_ = [("a.pdf", pdf_file(plain)), ("b.PDF", pdf_file(plain, flate=True)), ("c.pdf", pdf_file(mapped, unicode_map=True)), ("d.pdf", pdf_file([[]])), ("e.pdf", b"nothing"), ("f.pdf", pdf_file(plain).replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"))]
    got = {r.path: r for r in files.documents_of(spark.createDataFrame(files_, "path string, content binary")).collect()}
    expected = "--- Page 1 ---\nFirst line\na (b) \\ A \u00e9t\u00e9\n\n--- Page 3 ---\nThird page"
    assert got["a.pdf"].text == got["b.PDF"].text == expected and got["c.pdf"].text == "--- Page 1 ---\n\u0639 \u00e9\u4e2dA"
    assert [got[k].error_code for k in ("d.pdf", "e.pdf", "f.pdf")] == ["NO_TEXT", "BAD_FILE", "BAD_FILE"]


def read_back(report):
    return files.word_text(report).split("\n")


def test_word_reports_say_what_the_results_say(spark):
    """Every heading, bullet, number and table row of the reports, read back."""
    o = one(spark, (OUTLINE,), "text string", outline.draft_outline, "outline").asDict(True)
    lines = read_back(word.outline_report(o, "mail"))
    assert lines[:3] == ["Business Requirements Document", "Source: mail", "Preliminary; human review is required."]
    for i, key in enumerate(("stakeholders", "service_recipients", "functional_requirements", "non_functional_requirements", "business_rules", "process_steps", "required_data_and_documents", "integration_requirements", "missing_information", "human_review_notes"), 2):
        at = lines.index(f"{i}. {key.replace('_', ' ').title()}")
        mark = (lambda n: f"{n + 1}. ") if key == "process_steps" else (lambda n: "• ")
        assert lines[at + 1 : at + 1 + len(o[key])] == [mark(n) + v for n, v in enumerate(o[key])]
    assert f"Service purpose | {o['service_overview']['service_purpose']}" in lines
    r = one(spark, (REVIEW,), "text string", review.review_documents, "review").asDict(True)
    lines = read_back(word.review_report(r, "x"))
    assert "Completeness | 44%" in lines and "Section | Status | Evidence" in lines and "Stakeholders | Detected | stakeholder, applicant, employee" in lines
    assert all(f"• {x}" in lines for key in ("missing_sections", "wording_issues", "recommendations") for x in r[key])
    c = compare.compare_documents(spark.createDataFrame([(A, B, "BRD", "SRS")], "a_text string, b_text string, a_name string, b_name string")).first().comparison.asDict(True)
    lines = read_back(word.comparison_report(c))
    assert {"Document A | BRD", "Coverage | 67%", "Conflict 1 | 85%", "Partial match 1 | 68%", f"reason | {compare.CONFLICT}", f"A | {c['possible_conflicts'][0]['document_a_item']}"} <= set(lines)
    assert lines[lines.index("Matched items") + 1] == "None detected" and f"• {c['additional_in_document_b'][0]}" in lines


def test_word_reports_of_what_xml_cannot_hold():
    """Characters that no Word file can have are left out; line breaks, marks of XML and wide characters stay."""
    odd = "a\x00b\x0bc\x1fd\ufffe <&> \U0001f600 \ud800e\nf"
    assert read_back(word.Report("T" + odd).bullets([odd]).table([(odd, "x")]).save()) == [*("Tabcd <&> \U0001f600 e\nf".split("\n")), *("• abcd <&> \U0001f600 e\nf".split("\n")), *("abcd <&> \U0001f600 e\nf | x".split("\n"))]


def test_word_styles():
    """Headings, bullets and steps refer to styles that the file holds, of the font and sizes that reports have."""
    from xml.etree import ElementTree

    z = zipfile.ZipFile(io.BytesIO(word.Report("T").heading("H").bullets(["b"]).bullets(["s"], numbered=True).paragraph("p").save()))
    w = files.W
    held = {s.get(w + "styleId"): s for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(w + "style")}
    used = [p.get(w + "val") for p in ElementTree.fromstring(z.read("word/document.xml")).iter(w + "pStyle")]
    assert used == ["Title", "Heading1", "ListBullet", "ListNumber", "Normal"] and set(used) <= set(held)
    assert all(s.find(f"{w}rPr/{w}rFonts").get(w + "ascii") == "Arial" for s in held.values()) and held["Normal"].find(f"{w}rPr/{w}sz").get(w + "val") == "21"
    assert "styles.xml" in z.read("word/_rels/document.xml.rels").decode() and ElementTree.fromstring(z.read("[Content_Types].xml")) is not None


def test_sql_access(spark, sf_dir):
    """Functions and views by name."""
    import difflib

    from vellum.plans import access, catalog

    access.register_functions(spark)
    got = spark.sql("SELECT text_similarity('Tide', 'diet') AS a, text_similarity('diet', 'tide') AS b, text_similarity(NULL, 'x') AS c").first()
    assert (got.a, got.b, got.c) == (difflib.SequenceMatcher(None, "tide", "diet").ratio(), difflib.SequenceMatcher(None, "diet", "tide").ratio(), None)
    access.register_views(spark, sf_dir, "input_limits", "review_completeness")
    assert spark.sql("SELECT count(*) AS n FROM input_limits JOIN review_completeness USING (doc_id)").first().n == catalog.QUERIES["input_limits"](spark, sf_dir).count()


def test_pasted_texts(spark):
    assert [tuple(r) for r in files.pasted(spark, [(None, "a"), ("b", "c")]).collect()] == [("Manually entered text", "a"), ("b", "c")]


def test_required_keys(spark):
    """The keys that results must have are there."""
    o = one(spark, (OUTLINE,), "text string", outline.draft_outline, "outline")
    assert {"service_overview", "stakeholders", "business_rules", "process_steps", "human_review_notes"} <= set(o.asDict())


def test_pictures_hold_two_dots_to_a_byte():
    chart = {"tasks": None, "points": [{"category": c, "value": v} for c, v in (("a", 3.0), ("b", 5.0))], "chart_type": "Pie Chart", "title": "Parts", "x_label": "", "y_label": ""}
    image, canvas = png.chart_png(chart), png.draw(chart)
    assert image[24:26] == bytes([4, 3])
    start = image.index(b"IDAT")
    lines = np.frombuffer(zlib.decompress(image[start + 4 : image.index(b"IEND") - 8]), np.uint8).reshape(canvas.h, -1)[:, 1:]
    dots = np.stack([lines >> 4, lines & 15], axis=2).reshape(canvas.h, -1)[:, : canvas.w]
    assert (png.PALETTE[dots] == canvas.image).all()


@pytest.mark.parametrize("large", [20, 1 << 15])
@pytest.mark.parametrize("weights", [{}, {"text_weight": 0.0, "keyword_weight": 1.0}])
def test_pairs_are_compared_where_they_lie_or_dealt_out_alike(spark, monkeypatch, large, weights):
    """A pair that is not large is shuffled no more. The results are those of one row a pair."""
    monkeypatch.setattr(compare, "LARGE", large)
    many = " ".join(f"Number {i} of the rules holds for item {i % 7}." for i in range(70))
    given = [*fx.PAIRS, (9, A, B), (10, many, many.replace("holds for", "binds the")), (11, A, many), (12, None, A), (13, A, "")]
    pairs = fx.frame(spark, given, "pair_id long, a_text string, b_text string")
    side = lambda x: F.struct(F.lit(x).alias("side"), F.col(f"{x}_text").alias("text"))
    docs = pairs.select("pair_id", F.explode(F.array(side("a"), side("b"))).alias("d")).select("d.text", F.array(F.struct("pair_id", "d.side")).alias("sides"))
    sides = compare.item_sides(docs, F.col("sides"))
    whole = compare.compare_documents(pairs.selectExpr("*", "concat('A', pair_id) AS a_name", "cast(null as string) AS b_name"), **weights).cache()
    told = sorted(str(tuple(r)) for r in whole.select("pair_id", "error_code", "comparison").collect())
    dealt = compare.pair_comparisons(sides, "pair_id", a_name=F.concat(F.lit("A"), "pair_id"), b_name=F.lit(None).cast("string"), **weights)
    assert sorted(str(tuple(r)) for r in dealt.select("pair_id", "error_code", "comparison").collect()) == told
    c = "comparison.summary."
    figures = whole.select("pair_id", "error_code", "comparison.coverage_indicator", c + "matched_count", c + "missing_count", c + "possible_conflict_count", c + "additional_count")
    got = compare.pair_figures(sides, "pair_id", **weights).select("pair_id", "error_code", "coverage", "matched", "missing", "conflict", "additional")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, figures.collect())))
    extra = whole.where("comparison is not null").select("pair_id", F.explode("comparison.additional_in_document_b").alias("item"))
    assert sorted(map(tuple, compare.extra_items(sides, "pair_id", **weights).select("pair_id", "item").collect())) == sorted(map(tuple, extra.collect()))
    items = whole.where("error_code is null").select("pair_id", F.explode("matches").alias("m")).select("pair_id", "m.a_pos", "m.b_pos", "m.score", "m.class")
    assert sorted(map(tuple, compare.compare_items(sides, "pair_id", **weights).select("pair_id", "a_pos", "b_pos", "score", "class").collect())) == sorted(map(tuple, items.collect()))
    whole.unpersist()


def test_pictures_are_packed_by_lines_that_differ():
    """Every dot is as drawn, also of odd widths and single lines; the fast level of compression, as its mark says."""
    import struct
    import zlib

    from vellum.plans.corpus import _seen

    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 2), (5, 7), (40, 30), (9, 101)):
        cells = np.repeat(rng.integers(0, 10, (h, w), dtype=np.uint8), rng.integers(1, 5, h), axis=0)
        body = png.encode(cells)
        at = body.index(b"IDAT")
        packed = body[at + 4 : at + 4 + struct.unpack(">I", body[at - 4 : at])[0]]
        assert packed[1] >> 6 == 0
        rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(len(cells), -1)
        dots = np.stack([rows[:, 1:] >> 4, rows[:, 1:] & 15], axis=2).reshape(len(cells), -1)[:, :w]
        assert (dots == cells).all() and not rows[:, 0].any()
        if w % 2 == 0:
            assert _seen(body) == (w, len(cells), len(np.unique(cells)))
