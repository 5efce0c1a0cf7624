"""Summary of a mail: headers, priority, actions, deadlines, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import lexicons as lex, text as T

# Header names, sign-offs, sentinels.
HEADER_LINE = r"(?i)^(from|to|cc|bcc|subject|date|sent)" + T.WS + "*:"
NO_ACTION, NO_DEADLINE, NO_DECISION = "No clear action item detected.", "No clear deadline detected.", "No clear decision detected."
SIGN_OFF = r"(?i)^(regards|best regards|kind regards|thanks|thank you)[,!]?$"
NOTES = ["Review the original mail before acting.", "No mail account is connected."]


def body_of(mail_lines: Column) -> Column:
    """The lines but headers, up to the first that is a sign-off and nothing else, joined by spaces."""
    own = F.filter(mail_lines, lambda x: ~x.rlike(HEADER_LINE))
    return T.let(own, lambda ls: T.let(F.array_position(F.transform(ls, lambda x: x.rlike(SIGN_OFF)), True), lambda p: F.array_join(F.when(p == 0, ls).otherwise(F.slice(ls, F.lit(1), (p - 1).cast("int"))), " ")))


def priority_of(lowered: Column, high=lex.HIGH_PRIORITY, medium=lex.MEDIUM_PRIORITY) -> Column:
    return F.when(T.contains_any(lowered, high), "High").when(T.contains_any(lowered, medium), "Medium").otherwise("Normal")


def first_items(chosen: Column) -> Column:
    """Shortened, distinct but for case, the first five."""
    return F.slice(T.let(F.transform(chosen, lambda x: T.shorten(x)), T.distinct_ci), 1, lex.FIRST_ITEMS)


def deadlines_of(sentences: Column, patterns=lex.DEADLINES) -> Column:
    java = [p.replace(r"\s", T.WS).replace(r"\d", r"(?U:\d)") for p in patterns]
    return first_items(F.filter(sentences, lambda s: F.greatest(*(s.rlike("(?i)" + p) for p in java)) if len(java) > 1 else s.rlike("(?i)" + java[0])))


def summary_of(sentences: Column, topics=(*lex.ACTIONS, *lex.DECISIONS, *lex.TOPICS)) -> Column:
    """Up to four important sentences; if these are fewer than three, others fill up in order."""
    short = F.transform(sentences, lambda x: T.shorten(x))
    lead = F.transform(F.slice(T.mentioning(sentences, topics), 1, lex.SUMMARY_ITEMS), lambda x: T.shorten(x))
    filled = T.let(lead, lambda p: F.when(F.size(p) < 3, F.slice(F.concat(p, F.array_except(short, p)), 1, lex.SUMMARY_ITEMS)).otherwise(p))
    return T.or_else(filled, lex.UNCONFIRMED)


def summarize_mails(mails: DataFrame, text: str = "text", actions=lex.ACTIONS, decisions=lex.DECISIONS, topics=lex.TOPICS, high=lex.HIGH_PRIORITY, medium=lex.MEDIUM_PRIORITY, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``summary``, ``error_code`` and ``error_message``. Headers and priority come from the whole mail, the lists from its body.

    ``fields`` name those of the summary that are wanted, if not all: an error makes a summary null as a whole, so that
    Spark by itself makes all fields for the sake of one."""
    staged = mails.withColumn("__n", T.lines(F.col(text))).withColumn("__b", body_of(F.col("__n"))).withColumn("__s", T.mail_sentences(F.col("__b")))
    unsure = F.lit(lex.UNCONFIRMED)
    made = {
        **{name: F.coalesce(T.header(F.col("__n"), label), unsure) for label, name in (("From", "sender"), ("To", "recipient"), ("Subject", "subject"))},
        "priority": priority_of(F.lower(F.array_join("__n", "\n")), high, medium), "summary_bullets": summary_of(F.col("__s"), (*actions, *decisions, *topics)),
        "action_items": T.or_else(first_items(T.mentioning(F.col("__s"), actions)), NO_ACTION), "deadlines": T.or_else(deadlines_of(F.col("__s")), NO_DEADLINE),
        "decisions": T.or_else(first_items(T.mentioning(F.col("__s"), decisions)), NO_DECISION), "summary_mode": F.lit("Rule-based"), "human_review_notes": T.words_array(NOTES),
    }
    if unknown := set(fields or ()) - set(made):
        raise ValueError(f"no such fields of a summary: {', '.join(sorted(unknown))}")
    summary = F.struct(*(value.alias(name) for name, value in made.items() if fields is None or name in fields))
    code, message = T.first_error((F.size("__n") == 0, "EMPTY_EMAIL", "Email text is required before creating a summary."))
    return staged.withColumn("error_code", code).withColumn("error_message", message).withColumn("summary", F.when(code.isNull(), summary)).drop("__n", "__b", "__s")


def metrics(summary: str = "summary") -> dict[str, Column]:
    """Counts to show beside a summary: of the deadlines only those found, of the others all entries."""
    of = lambda f: F.col(f"{summary}.{f}")
    return {"summary_bullets": F.size(of("summary_bullets")), "action_items": F.size(of("action_items")), "deadlines": T.count_but(of("deadlines"), NO_DEADLINE)}
