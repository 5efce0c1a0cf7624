"""Size limits and figures of inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import lexicons as lex


def too_long(text: Column, limit: int = lex.MAX_DOCUMENT) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) > limit


def check_limits(rows: DataFrame, document: str = "text", question: str | None = None, limit: int = lex.MAX_DOCUMENT, question_limit: int = lex.MAX_QUESTION) -> DataFrame:
    """Adds ``input_too_long``; only more than the limit is too long."""
    broken = too_long(F.col(document), limit)
    return rows.withColumn("input_too_long", broken | too_long(F.col(question), question_limit) if question else broken)


def run_gate(rows: DataFrame, confirmed: bool, document: str = "text", question: str | None = None) -> DataFrame:
    """The rows that may run: the use of the data is confirmed and nothing is too long."""
    return check_limits(rows, document, question).where(F.lit(confirmed) & ~F.col("input_too_long")).drop("input_too_long")


#: Characters of the previews of results, of two compared texts, of sources; what follows a cut one.
PREVIEW, PAIR_PREVIEW, SOURCE_PREVIEW = 1500, 2000, 3000
SHORTENED = "\n\n[Preview shortened. The full text remains available.]"


def preview(text: Column, limit: int = PREVIEW, after: str = "...") -> Column:
    """At most ``limit`` characters, and a mark after a text that is cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(after))).otherwise(text)
