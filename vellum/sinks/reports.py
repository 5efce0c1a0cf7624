"""Text and JSON outputs of the operators' results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, functions as F


def pretty_json(result: Row | dict) -> str:
    """One result, indented, keys in their order, characters as they are."""
    return json.dumps(result.asDict(True) if isinstance(result, Row) else result, indent=2, ensure_ascii=False, default=str)


def write_json(results: DataFrame, path: str, *drop: str) -> None:
    """One JSON object a line, for a whole corpus; ``drop``: binary columns."""
    results.drop(*drop).write.mode("errorifexists").json(path)


def bullets(values: Column) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit("- "), x))


def _section(title: str, values: Column) -> Column:
    return F.concat(F.array(F.lit(""), F.lit(title)), values)


def mail_report(summary: str = "summary") -> Column:
    """A mail's summary as plain text."""
    s = lambda f: F.col(f"{summary}.{f}")
    head = F.array(F.lit("Email Summary"), F.lit(""), *(F.concat(F.lit(f"{n}: "), s(f)) for n, f in (("From", "sender"), ("To", "recipient"), ("Subject", "subject"), ("Priority", "priority"))))
    rest = [_section(t, bullets(s(f))) for t, f in (("SHORT SUMMARY", "summary_bullets"), ("ACTION ITEMS", "action_items"), ("DEADLINES", "deadlines"), ("DECISIONS", "decisions"), ("HUMAN REVIEW NOTES", "human_review_notes"))]
    return F.array_join(F.concat(head, *rest), "\n")


def answer_report(answer: str = "answer", source_name: Column | None = None) -> Column:
    """An answer with its passages as plain text."""
    a = lambda f: F.col(f"{answer}.{f}")
    none = lambda values, text: F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(text)))
    percent = lambda x: F.format_string("%.0f%%", F.rint(x * 100))
    shown = F.transform(a("supporting_passages"), lambda p: F.concat(F.lit("- "), p["passage"], F.lit(" (score: "), percent(p["relevance_score"]), F.lit(")")))
    head = F.array(F.lit("Preliminary Response"), F.lit(""), F.concat(F.lit("Reference source: "), source_name if source_name is not None else F.lit("Manually entered text")), F.concat(F.lit("Question: "), a("question")), F.concat(F.lit("Status: "), a("answer_status")), F.concat(F.lit("Confidence indicator: "), a("confidence_indicator")))
    rest = [
        _section("ANSWER", F.array(a("answer"))), _section("SUPPORTING INFORMATION", none(shown, "- No sufficiently relevant passage identified.")),
        _section("INFORMATION REQUIRING CONFIRMATION", none(bullets(a("missing_information")), "- No specific missing information detected.")), _section("HUMAN REVIEW NOTES", bullets(a("human_review_notes"))),
    ]
    return F.array_join(F.concat(head, *rest), "\n")


def file_name(kind: Column | str, suffix: str) -> Column:
    """A neutral download name: lower case, words joined by underscores."""
    return F.concat(F.replace(F.lower(F.lit(kind) if isinstance(kind, str) else kind), F.lit(" "), F.lit("_")), F.lit(suffix))
