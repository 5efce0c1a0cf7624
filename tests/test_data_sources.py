"""Files as a data source, batch and stream, and reports as a sink; and the join with a large lexicon."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import charts, compare, lexicon, outline, review
from vellum.plans import access, catalog, derived, corpus, fixtures as fx  # noqa: F401  queries
from vellum.sinks import files_sink, pdf
from vellum.sources import files, files_source, pdf as pdf_source, shared, tables
from vellum.sources.pdf import pages_of, rc4, unpredicted

TEXTS = [(i, f"text {i} é.\n" * (1 + i % 4)) for i in range(23)]


@pytest.fixture(scope="module")
def formats(spark):
    access.register_sources(spark)
    return spark


def folder_of(tmp_path):
    return f"file://{tmp_path}/out"


def write(df, folder, report="text", mode="append"):
    df.write.format("vellum_reports").option("report", report).mode(mode).save(folder)


def named(spark, rows, ending=".txt", parts=4):
    return spark.createDataFrame([(f"{i}{ending}", t) for i, t in rows], "name string, result string").repartition(parts)


def read(spark, folder, **options):
    return spark.read.format("vellum_files").options(**options).load(folder)


def test_written_files_are_read(formats, tmp_path):
    write(named(formats, TEXTS), folder_of(tmp_path))
    got = {r["name"]: (r["kind"], r["bytes"], r["text"], r["error_code"]) for r in read(formats, folder_of(tmp_path), taskBytes="40").collect()}
    assert got == {f"{i}.txt": ("txt", len(t.encode()), t.strip(), None) for i, t in TEXTS}
    assert read(formats, folder_of(tmp_path), taskBytes="40").rdd.getNumPartitions() > 10
    assert read(formats, folder_of(tmp_path)).rdd.getNumPartitions() == 1
    assert not glob.glob(f"{tmp_path}/out/_*") and len(os.listdir(tmp_path / "out")) == len(TEXTS)


def test_the_rules_are_those_of_the_columns(formats, tmp_path):
    """One file read by a task gives what ``documents_of`` gives for the same bytes."""
    cases = [*fx.FILES, ("c/x.pdf", b"%PDF-nothing"), ("d/UP.TXT", "   é \x1c".encode()), ("noending", b"x")]
    for name, body in cases:
        (tmp_path / "in" / os.path.dirname(name)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(body)
    (tmp_path / "in" / "_hidden").mkdir()
    (tmp_path / "in" / "_hidden" / "x.txt").write_bytes(b"never read")
    got = sorted((r["path"].split("/in/")[1], r["text"], r["error_code"]) for r in read(formats, f"file://{tmp_path}/in").collect())
    expected = files.documents_of(formats.createDataFrame([(n, bytearray(b)) for n, b in cases], "path string, content binary")).collect()
    assert got == sorted((r["path"], r["text"], r["error_code"]) for r in expected)
    assert read(formats, f"file://{tmp_path}/none").count() == 0


def test_columns_and_filters(formats, tmp_path, monkeypatch):
    write(named(formats, TEXTS), folder_of(tmp_path))
    write(named(formats, TEXTS, ".docx"), folder_of(tmp_path))  # not what the name says
    only = formats.read.format("vellum_files").schema("kind string, path string").load(folder_of(tmp_path))
    assert only.columns == ["kind", "path"] and only.where("kind = 'docx'").count() == len(TEXTS)
    reader = files_source.FileReader(folder_of(tmp_path), ["name"], 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    left = list(reader.pushFilters([EqualTo(("kind",), "txt"), GreaterThan(("bytes",), 5), StringEndsWith(("name",), "1.txt")]))
    assert left == [GreaterThan(("bytes",), 5)]
    assert sorted(f.path.rsplit("/", 1)[1] for p in reader.partitions() for f in p.files) == ["1.txt", "11.txt", "21.txt"]
    rows = read(formats, folder_of(tmp_path)).where("kind = 'txt' and bytes > 15 and path like '%1.txt'").collect()
    assert sorted(r["name"] for r in rows) == sorted(f"{i}.txt" for i, t in TEXTS if i % 10 == 1 and len(t.encode()) > 15)
    with pytest.raises(Exception, match="no such columns"):
        formats.read.format("vellum_files").schema("other string").load(folder_of(tmp_path)).collect()


def test_stream_gives_what_a_batch_gives(formats, tmp_path):
    folder, out, state = folder_of(tmp_path), f"{tmp_path}/rows", f"{tmp_path}/state"
    write(named(formats, TEXTS[:10]), folder)

    def run():
        stream = formats.readStream.format("vellum_files").option("taskBytes", "60").load(folder).select("name", "text")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    assert formats.read.parquet(out).count() == 10
    write(named(formats, TEXTS[10:]), folder)
    run()
    run()
    assert sorted(map(tuple, formats.read.parquet(out).collect())) == sorted((r["name"], r["text"]) for r in read(formats, folder).collect())


def test_reports_from_a_stream(formats, tmp_path):
    """Documents that arrive in two goes, reviewed as they come: the same reports as of a batch over all."""
    given, out = folder_of(tmp_path / "in"), folder_of(tmp_path / "reports")
    texts = [(i, f"The system must notify applicant {i}. Security is adequate. " * (1 + i % 3)) for i in range(17)]
    reviewed = lambda docs: review.review_documents(docs).where("review is not null").select(F.concat("name", F.lit(".docx")).alias("name"), F.col("name").alias("source"), "review")

    def run():
        stream = reviewed(formats.readStream.format("vellum_files").option("taskBytes", "300").load(given))
        stream.writeStream.format("vellum_reports").option("report", "review").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    for part in (texts[:9], texts[9:], []):
        if part:
            write(named(formats, part), given)
        run()
    write(reviewed(read(formats, given)), folder_of(tmp_path / "batch"), "review")
    both = [sorted((r["name"], r["text"]) for r in read(formats, f).collect()) for f in (out, folder_of(tmp_path / "batch"))]
    assert both[0] == both[1] and len(both[0]) == len(texts)
    assert sorted(os.listdir(tmp_path / "reports" / "out")) == sorted(f"{i}.txt.docx" for i, _ in texts)


def test_a_batch_of_a_stream_that_is_done_again(formats, tmp_path):
    """A batch that dies after its commit, but before Spark notes it, is done again; one file is left of each row, and no attempt."""
    from pyspark.sql import Row

    on = lambda: files_sink.ReportStreamWriter(folder_of(tmp_path), "text")  # noqa: E731  tasks and the driver have one each
    rows = [Row(name="a.txt", result="first"), Row(name="b.txt", result="second")]
    for _ in range(2):
        task = on()
        with pytest.raises(ZeroDivisionError):
            task.write(iter_then_fail(rows[:1]))
        on().commit([task.write(iter(rows[:1])), None, task.write(iter(rows[1:])), task.write(iter([]))], 0)
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.txt": "first", "b.txt": "second"}
    task = on()
    with pytest.raises(ValueError, match="one file name"):
        on().commit([task.write(iter(rows[:1])), task.write(iter(rows[:1]))], 1)
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt"]


def iter_then_fail(rows):
    yield from rows
    raise ZeroDivisionError


def test_an_attempt_that_dies_leaves_nothing(formats, tmp_path, monkeypatch):
    """The files of a first attempt, ended half-way, are no part of the result of a second."""
    writer = files_sink.ReportWriter(folder_of(tmp_path), "text", False)
    from pyspark.sql import Row

    def dying():
        yield Row(name="a.txt", result="half")
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    again = writer.write(iter([Row(name="a.txt", result="whole"), Row(name="b.txt", result=None)]))
    writer.commit([again])
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.txt": "whole", "b.txt": ""}


def test_a_task_that_is_tried_again(formats, tmp_path):
    """A job whose tasks die once, after some files, and a job that fails."""
    mark = str(tmp_path / "died")

    @F.udf("string")
    def once(text):
        import os as o

        if "text 7" in text and o.path.exists(mark):
            raise RuntimeError("always" if o.path.isdir(mark) else "once")
        return text

    os.makedirs(mark)
    with pytest.raises(Exception):
        write(named(formats, TEXTS, parts=1).withColumn("result", once("result")), folder_of(tmp_path))
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []
    os.rmdir(mark)
    write(named(formats, TEXTS, parts=1).withColumn("result", once("result")), folder_of(tmp_path))
    assert len(os.listdir(tmp_path / "out")) == len(TEXTS)


def test_names_and_modes(formats, tmp_path):
    folder = folder_of(tmp_path)
    write(named(formats, TEXTS[:3]), folder)
    with pytest.raises(Exception, match="there already"):
        write(named(formats, TEXTS[2:5]), folder)
    assert len(os.listdir(tmp_path / "out")) == 3
    write(named(formats, TEXTS[2:5]), folder, mode="overwrite")
    assert sorted(os.listdir(tmp_path / "out")) == ["2.txt", "3.txt", "4.txt"]
    for bad in ([(1, "a"), (1, "b")], [("../x", "a")], [("_x", "a")]):
        with pytest.raises(Exception, match="one file name|file of its own"):
            write(named(formats, bad, parts=2), folder_of(tmp_path / "other"))
    with pytest.raises(Exception, match="columns needed"):
        write(named(formats, TEXTS), folder, "review")
    with pytest.raises(Exception, match="option report"):
        write(named(formats, TEXTS), folder, "poem")


def test_all_reports(formats, tmp_path):
    docs = fx.frame(formats, fx.DOCUMENTS, "doc_id long, kind string, text string").withColumn("source", F.lit("s")).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".docx")))
    tables = fx.frame(formats, fx.CHARTS, "doc_id long, chart_type string, data_text string, title string").withColumn("x_label", F.lit("")).withColumn("y_label", F.lit("")).withColumn("name", F.concat(F.col("doc_id").cast("string"), F.lit(".png")))
    pairs = fx.frame(formats, fx.PAIRS, "pair_id long, a_text string, b_text string").withColumn("a_name", F.lit("A")).withColumn("b_name", F.lit("B")).withColumn("name", F.concat(F.col("pair_id").cast("string"), F.lit(".docx")))
    given = {
        "outline": outline.draft_outline(docs).where("outline is not null"), "review": review.review_documents(docs, document_type=F.col("kind")).where("review is not null"),
        "comparison": compare.compare_documents(pairs).where("comparison is not null"), "chart": charts.chart_data(tables).where("chart is not null"), "json": review.review_documents(docs).withColumnRenamed("review", "result"),
    }
    for report, rows in given.items():
        write(rows, folder_of(tmp_path / report), report)
        found = read(formats, folder_of(tmp_path / report)).collect()
        assert len(found) == rows.count() > 0
        if report in ("outline", "review", "comparison"):
            assert all(r["error_code"] is None and len(r["text"]) > 100 for r in found)
    assert all(p.read_bytes()[:8] == b"\x89PNG\r\n\x1a\n" for p in (tmp_path / "chart" / "out").iterdir())


@pytest.mark.parametrize("limit", [lexicon.BROADCAST_KEYWORDS, 1])
def test_large_lexicon(spark, sf_dir, limit):
    """As many keywords as the documents give, short and odd ones too, against plain containment; broadcast and shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "A  b\n中文 字符"), (-4, "aaaa")], "doc_id long, text string"))
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()).lower() for r in docs.collect()}
    rng = random.Random(1)
    every = sorted({w for t in texts.values() for w in t.split()})
    keywords = every + [t[i : i + rng.randint(1, 25)] for t in rng.sample(sorted(texts.values()), 50) if len(t) > 30 for i in (rng.randrange(len(t) - 25),)] + ["a", "中", "aa", "aaa", "aaaa", "aaaaa", "zzqx", "", None, "The", "the", "文 字"]
    got = {}
    for r in lexicon.found_keywords(docs, spark.createDataFrame([(k,) for k in keywords], "keyword string"), "doc_id", limit=limit).collect():
        got.setdefault(r["doc_id"], []).append(r["keyword"])
    own = {k.lower() for k in keywords if k}
    by_id = {d: sorted(k for k in own if k in t) for d, t in texts.items()}
    assert {d: sorted(v) for d, v in got.items()} == {d: v for d, v in by_id.items() if v}


def test_lexicon_looks_words_up_once(spark):
    """Texts meet the lexicon word by word where they lie: no shuffle, no row for each piece of a text; a full memory of words starts anew."""
    docs = spark.createDataFrame([(1, "New york  is new"), (1, "York NEW"), (2, "w york\tise"), (None, "x" * 40)], "doc_id long, text string")
    words = spark.createDataFrame([(k,) for k in ("new york", "york", "w y", " ", "is", "york new", "x" * 39)], "keyword string")
    rows = lexicon.keyword_lists(docs, words, "doc_id")
    assert sorted((r["doc_id"] or 0, r["keywords"]) for r in rows.collect()) == [(0, ["x" * 39]), (1, [" ", "is", "new york", "w y", "york"]), (1, [" ", "york", "york new"]), (2, [" ", "is", "w y", "york"])]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    few = lexicon.Pieces(["ab", "b"])
    few.held = lexicon.KNOWN_CHARS
    assert few.of_text("cab b cab") == [0, 1] and few.held == 4


def test_lexicon_of_nothing(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert lexicon.found_keywords(docs, spark.createDataFrame([("",), (None,)], "keyword string"), "doc_id").count() == 0


def test_join_equals_the_literal_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = ["tion", "the ", "de", "ment.", "x"]
    plan = lexicon.found_keywords(docs, spark.createDataFrame([(w,) for w in words], "keyword string"), "doc_id")
    literal = docs.select("doc_id", F.explode(T.found_words(F.lower(T.collapse(F.col("text"))), words)).alias("keyword"))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, literal.collect()))
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("form", range(8))
def test_pdf_forms(form):
    """Objects in a table or in streams with predictors, Latin and composite fonts, encrypted or not; several pages."""
    text = "\n".join(f"line {i} é (x) \\ü  end" for i in range(65)) + "\n\n  last 中文"
    lines = [x for x in text.split("\n") if x.strip()]
    body = pdf.text_pdf(text, bool(form & 1), bool(form & 2), bool(form & 4))
    expected = ["\n".join(lines[i : i + pdf.LINES]) for i in range(0, len(lines), pdf.LINES)]
    assert pages_of(body) == [x if form & 2 else x.replace("中文", "??") for x in expected]
    assert (b"line 1" in body, b"/Encrypt" in body, b"/ObjStm" in body) == (False, bool(form & 4), bool(form & 1))


def test_pdf_codes_are_read_together(monkeypatch):
    """A string whose codes are all of one length is read at once; of several lengths, code by code; RC4 by its known results."""
    monkeypatch.setattr(pdf_source, "int", None, raising=False)
    assert list(pdf_source.codes_of(b"a\xe9", [(1, 0, 255)])) == [97, 233] and list(pdf_source.codes_of(b"\0a\x4e\x2d", [(2, 0, 65535)])) == [97, 0x4E2D]
    monkeypatch.undo()
    assert pdf_source.codes_of(b"a\x81\x40b", [(1, 0, 127), (2, 0x8100, 0x9FFF)]) == [97, 0x8140, 98]
    assert pdf_source.codes_of(b"\0ab", [(2, 0, 65535)]) == [97, 98]
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and rc4(b"Wiki", b"") == b"" and rc4(b"k", rc4(b"k", bytes(range(256)) * 3)) == bytes(range(256)) * 3


def test_tasks_grow_with_a_table_of_few_files(spark, tmp_path, monkeypatch):
    """One file: as many tasks as its size asks for, not the number of cores whatever its size; many files stay as they lie."""
    spark.range(20_000).selectExpr("id AS doc_id", "cast(id AS string) AS text").coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    spark.range(64).repartition(64).write.parquet(f"{tmp_path}/many.parquet")
    tasks = lambda name: tables.spread(tables.read_table(spark, str(tmp_path), name)).rdd.getNumPartitions()
    assert tasks("one") == spark.sparkContext.defaultParallelism
    few = tables.spread(tables.read_table(spark, str(tmp_path), "many"))
    assert "Repartition" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(tables, "TASK_BYTES", 4096)
    assert 20 < tasks("one") < 100


@pytest.mark.parametrize("name", ["source_word", "source_pdf", "source_documents"])
def test_files_go_to_python_in_bounded_batches(spark, sf_dir, name):
    """Batches of files are bounded by bytes, not by 10,000 rows alone, and a table of one file is no single task."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = catalog.QUERIES[name](spark, sf_dir)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(shared.BATCH_BYTES)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_results_go_to_files_in_bounded_batches(spark, tmp_path):
    """Batches that a task writes as files are bounded by bytes, and as many files are there in the end."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    access.register_sources(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(shared.BATCH_BYTES)
    write(named(spark, [(i, "x" * 3_000_000) for i in range(5)], parts=1), folder_of(tmp_path))
    assert read(spark, folder_of(tmp_path)).where("bytes = 3000000").count() == 5


def test_pdf_that_needs_a_password():
    body = pdf.text_pdf("text", locked=True)
    mark = body.index(b"/U <") + 4
    with pytest.raises(ValueError, match="password"):
        pages_of(body[:mark] + b"00" * 16 + body[mark + 32 :])
    with pytest.raises(ValueError, match="not supported"):
        pages_of(body.replace(b"/V 2", b"/V 5"))


def test_pdf_arithmetic():
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3" and rc4(b"Secret", b"Attack at dawn").hex() == "45a01f645fc35b383552544b9bf5"
    rows = [bytes([k]) + bytes(row) for k, row in enumerate([[1, 2, 3, 4], [1, 1, 1, 1], [1, 1, 1, 1], [2, 2, 2, 2], [3, 0, 1, 255]])]
    assert list(unpredicted(b"".join(rows), 4, 1)) == [1, 2, 3, 4, 1, 2, 3, 4, 2, 3, 4, 5, 3, 5, 6, 7, 6, 6, 7, 6]


def test_codes_of_several_lengths():
    """A composite font whose codes have one byte or two, as its map says."""
    told = b"1 begincodespacerange <00> <7f> endcodespacerange 1 begincodespacerange <8000> <ffff> endcodespacerange 2 beginbfchar <41> <0061> <8141> <4e2d> endbfchar 1 beginbfrange <42> <44> <0062> endbfrange"
    page = b"BT /F1 9 Tf <4142814144> Tj ET"
    body = b"%%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Kids [3 0 R]>> endobj 3 0 obj <</Contents 4 0 R /Resources <</Font <</F1 5 0 R>>>>>> endobj 4 0 obj <</Length %d>>\nstream\n%s\nendstream endobj 5 0 obj <</Subtype /Type0 /ToUnicode 6 0 R>> endobj 6 0 obj <</Length %d>>\nstream\n%s\nendstream endobj" % (len(page), page, len(told), told)
    assert pages_of(body) == ["ab中d"]


def test_names_of_a_task_are_not_searched_one_by_one(tmp_path):
    from vellum.sinks.files_sink import ReportWriter

    compared = []

    class Name(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            compared.append(1)
            return str.__eq__(self, other)

    writer = ReportWriter(f"file://{tmp_path}/out", "text", False)
    done = writer.write(iter([{"name": Name(f"{i}.txt"), "result": "x"} for i in range(300)]))
    assert len(done.names) == 300 and len(compared) < 300
    with pytest.raises(ValueError):
        writer.write(iter([{"name": "a", "result": "x"}, {"name": "a", "result": "y"}]))


def test_files_in_folders_pass_the_driver_by_folder(formats, tmp_path, monkeypatch):
    """The driver holds nothing of single files: tasks tell it their folder, and are told folders to read."""
    from pyspark.sql import Row

    rows = [Row(name=f"{i}.{'md' if i % 3 else 'txt'}", result=f"text {i} " * 20) for i in range(200)]
    monkeypatch.setattr(files_sink, "FOLDER_BYTES", 2000)
    writer = files_sink.ReportWriter(folder_of(tmp_path), "text", False, folders=True)
    told = [writer.write(iter(part)) for part in (rows[:100], rows[100:], [])]
    assert all(len(m.names) < 2 for m in told)
    writer.commit([*told, None])
    assert len(os.listdir(tmp_path / "out")) == 2 and len(glob.glob(f"{tmp_path}/out/*/*/*")) == len(rows)
    reader = files_source.FileReader(folder_of(tmp_path), ["name", "text"], 8000)
    parts = reader.partitions()
    assert sum(len(p.files) for p in parts) < len(rows) / 3 and len(parts) > 3
    assert sorted(r for p in parts for r in reader.read(p)) == sorted((r["name"], r["result"].strip() if r["name"].endswith("txt") else None) for r in rows)
    reader.tests.append(("=", "kind", "txt"))
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == sorted(r["name"] for r in rows if r["name"].endswith("txt"))
    df = formats.createDataFrame([(r["name"], r["result"]) for r in rows], "name string, result string").repartition(3)
    df.write.format("vellum_reports").option("report", "text").option("folders", "true").mode("append").save(folder_of(tmp_path / "b"))
    assert sorted(r["name"] for r in read(formats, folder_of(tmp_path / "b")).collect()) == sorted(r["name"] for r in rows)
    assert not glob.glob(f"{tmp_path}/b/out/_*")
