"""Results as indented JSON and their figures, without Python on the way of a row and without a second pass."""

import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from vellum.operators import charts, compare, email, metrics, outline, qa, review
from vellum.plans import fixtures as fx
from vellum.sinks.json_text import decimal, pretty, quoted
from vellum.sinks.reports import pretty_json


def test_texts_as_json(spark):
    texts = ["", "plain", 'say "x" \\ y', "tab\tnew\nline\r\b\f", "".join(map(chr, range(40))), "é 中 😀 \x7f  ", "\\u0001", "\\\\\"", "a\x00b\x1fc"]
    assert [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(quoted(F.col("t")).alias("j")).collect()] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_doubles_as_json(spark):
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 0.76, 123456.789, 1e6, 9999999.0, 1e7, 1.5e7, 123456789.125, 1e15, 1e16, 1.2345e16, 1e22, 1e100, 1.5e-3, 1e-3, 9.9e-4, 1e-4, 1.25e-4, 9.9e-5, 1e-5, -2.5e-7, 1e-100, 3.0e-300, 1e300, 2.0**53, math.pi, -math.pi * 1e20]
    assert [r.j for r in spark.createDataFrame([(v,) for v in values], "v double").select(decimal(F.col("v")).alias("j")).collect()] == [json.dumps(v) for v in values]


def test_nested_values(spark):
    schema = "a struct<n: int, l: array<struct<x: string, y: double>>, e: array<string>, z: struct<q: boolean>, d: date, m: array<array<long>>>"
    rows = [({"n": 1, "l": [{"x": "é\"", "y": 0.5}, None, {"x": None, "y": None}], "e": [], "z": {"q": True}, "d": datetime.date(2026, 8, 1), "m": [[1, 2], [], None]},), ({"n": None, "l": None, "e": [None, "b"], "z": None, "d": None, "m": []},), (None,)]
    df = spark.createDataFrame(rows, schema)
    got = df.select("a", pretty(F.col("a"), df.schema["a"].dataType).alias("j")).collect()
    assert [r.j for r in got] == ["null" if r.a is None else pretty_json(r.a) for r in got]


def results(spark, sf_dir):
    """The results of all six tasks: on the fixtures and on the driver's documents."""
    made = fx.frame(spark, fx.DOCUMENTS, "doc_id long, kind string, text string").select("doc_id", "kind", "text")
    docs = made.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("SRS").alias("kind"), "text"))
    asked = docs.withColumn("question", F.substring("text", 5, 60)).select("text", "question").unionByName(fx.frame(spark, fx.QUESTIONS, "i long, text string, question string").drop("i"))
    pairs = fx.frame(spark, fx.PAIRS, "i long, a_text string, b_text string").withColumn("a_name", F.lit(None).cast("string")).withColumn("b_name", F.lit("B"))
    tables = fx.frame(spark, fx.CHARTS, "i long, chart_type string, data_text string, title string").withColumn("x_label", F.lit("")).withColumn("y_label", F.lit(""))
    mails = docs.select("text").unionByName(fx.frame(spark, fx.MAILS, "i long, text string").drop("i"))
    return {"outline": outline.draft_outline(docs), "review": review.review_documents(docs, document_type=F.col("kind")), "comparison": compare.compare_documents(pairs), "summary": email.summarize_mails(mails), "answer": qa.answer_questions(asked, "text", "question"), "chart": charts.chart_data(tables)}


@pytest.mark.parametrize("task", ["outline", "review", "comparison", "summary", "answer", "chart"])
def test_results_as_json_and_their_figures(spark, sf_dir, task):
    """Byte for byte what Python writes; and sums told by the job that makes the results."""
    rows = results(spark, sf_dir)[task]
    got = rows.where(F.col(task).isNotNull()).select(task, pretty(F.col(task), rows.schema[task].dataType).alias("j")).collect()
    assert len(got) > 0 and [r.j for r in got] == [pretty_json(r[task]) for r in got]
    shown = metrics.figures(task)
    kept, seen = metrics.observed(rows, shown)
    kept.write.format("noop").mode("overwrite").save()
    plain = rows.select("error_code", *(c.alias(k) for k, c in shown.items())).collect()
    expected = {"results": sum(r.error_code is None for r in plain), "errors": sum(r.error_code is not None for r in plain), **{k: sum(r[k] or 0 for r in plain) for k in shown}}
    assert seen.get == expected and expected["results"] == len(got) and expected["errors"] > 0


def test_figures_of_a_stream(spark, sf_dir, tmp_path):
    """A stream in several batches tells the sums of a batch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(5).write.parquet(f"{tmp_path}/in")
    totals = metrics.Totals("reviewed")
    spark.streams.addListener(totals)
    try:
        read = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        done = review.review_documents(read).observe("reviewed", *metrics.sums(metrics.figures("review")))
        done.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        kept, seen = metrics.observed(review.review_documents(docs), metrics.figures("review"))
        kept.write.format("noop").mode("overwrite").save()
        import time

        for _ in range(100):  # events come after the stream has ended
            if totals.values == seen.get:
                break
            time.sleep(0.1)
        assert totals.values == seen.get and seen.get["results"] > 0
    finally:
        spark.streams.removeListener(totals)


def test_mail_fields_that_are_not_wanted_are_not_made(spark, sf_dir):
    """Some fields of a summary are as they are among all; headers read no sentences."""
    from vellum.plans import catalog

    mails = spark.createDataFrame([("From: a\nTo: b\nPlease send it by tomorrow to us.\nWe agreed on 3/4 then.",), (" \n",), (None,)], "text string")
    every, some = email.summarize_mails(mails).collect(), email.summarize_mails(mails, fields=("deadlines", "sender")).collect()
    assert [r.summary and r.summary.asDict() for r in some] == [r.summary and {k: r.summary[k] for k in ("sender", "deadlines")} for r in every]
    assert [r.error_code for r in some] == [None, "EMPTY_EMAIL", "EMPTY_EMAIL"]
    assert "RLIKE" not in catalog.QUERIES["email_headers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="no such fields"):
        email.summarize_mails(mails, fields=("sendr",))


def test_mail_figures_count_what_was_planted(spark, tmp_path):
    """Words of actions that a document has by itself, as in an address, and mails without lines are as the SQL says."""
    import duckdb

    from vellum.plans import derived  # noqa: F401  registers the query
    from vellum.plans.registry import ORACLE_SQL, QUERIES

    texts = ["Ask asendi.24@mail6.example.com for it. Then one more line.", "Please Send it by tomorrow to us. We must do it. All should review it.", "nothing of the kind here", "", " \n", None]
    rows = [(8 * i + j, t) for i, t in enumerate(texts) for j in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sorted(con.execute(f"SELECT doc_id, n_deadlines, deadlines_md5, n_actions_found, n_actions FROM ({ORACLE_SQL['email_metrics']})").fetchall())
    assert sorted(map(tuple, QUERIES["email_metrics"](spark, str(tmp_path)).collect())) == expected and len(expected) == len(rows)
