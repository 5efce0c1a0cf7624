"""A requirements outline drafted from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.functions import lexicons as lex, text as T

PROMPT_TASK = "Draft a business requirements document from the source below. Use only what it says; write 'Requires confirmation' where it says nothing."
OPEN_POINTS = [f"{x} requires confirmation." for x in ("Responsible government entity", "Processing time", "Approval authority", "Integration method")] + ["Non-functional requirements require confirmation."]
NOTES = ["The outline is drafted by rules.", "A Business Analyst must review and approve it."]


def service_name(text: Column) -> Column:
    """What a verb of automation is said to act on, up to the word service; the verbs in order of priority."""
    found = [F.nullif(F.regexp_extract(text, rf"(?i){verb} (?:a|an|the) ([^.]*?service)", 1), F.lit("")) for verb in lex.SERVICE_VERBS]
    return T.capitalized(F.trim(F.coalesce(*found)))


def draft_outline(docs: DataFrame, text: str = "text", functional=lex.FUNCTIONAL_VERBS, rules=lex.RULE_CUES, stakeholders=lex.STAKEHOLDERS, recipients=lex.RECIPIENTS, required=lex.REQUIRED_INFORMATION) -> DataFrame:
    """Adds ``outline``, ``error_code`` and ``error_message``. Empty texts get an error and no outline."""
    whole = T.collapse(F.col(text))
    staged = docs.withColumn("__t", whole).withColumn("__s", T.sentences(F.col(text))).withColumn("__l", F.lower("__t"))
    unsure = F.lit(lex.UNCONFIRMED)
    listed = lambda c: T.or_else(c, lex.UNCONFIRMED)
    outline = F.struct(
        F.struct(F.coalesce(service_name(F.col("__t")), unsure).alias("service_name"), F.coalesce(F.try_element_at("__s", F.lit(1)), unsure).alias("service_purpose"), unsure.alias("service_scope")).alias("service_overview"),
        listed(T.labels_of(F.col("__l"), stakeholders)).alias("stakeholders"), listed(T.labels_of(F.col("__l"), recipients)).alias("service_recipients"),
        listed(F.array_distinct(T.mentioning(F.col("__s"), functional))).alias("functional_requirements"), F.array(unsure).alias("non_functional_requirements"),
        listed(F.array_distinct(T.mentioning(F.col("__s"), rules))).alias("business_rules"), F.col("__s").alias("process_steps"),
        listed(T.labels_of(F.col("__l"), required)).alias("required_data_and_documents"), F.array(unsure).alias("integration_requirements"),
        T.words_array(OPEN_POINTS).alias("missing_information"), T.words_array(NOTES).alias("human_review_notes"),
    )
    code, message = T.first_error((F.col("__t") == "", "EMPTY_SOURCE", "Source information is required."))
    return staged.withColumn("outline", F.when(F.col("__t") != "", outline)).withColumn("error_code", code).withColumn("error_message", message).drop("__t", "__s", "__l")


def outline_prompt(text: Column) -> Column:
    """A prompt that asks for an outline of the text; null for an empty one."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{T.WS}+|{T.WS}+$", "")
    return F.when(body != "", F.concat(F.lit(PROMPT_TASK + "\n\n--- SOURCE START ---\n"), body, F.lit("\n--- SOURCE END ---")))
