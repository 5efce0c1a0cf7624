"""Text functions, Column to Column: normalising, splitting, tokens, keyword tests. All run in the JVM, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from vellum.functions import lexicons as lex

#: All characters that count as white space, as a class (Java's own classes lack some).
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def lines(text: Column) -> Column:
    """The lines of a mail: each collapsed, blank ones dropped."""
    return F.filter(F.transform(F.split(unix_lines(text), "\n", -1), collapse), lambda x: x != "")


def word_count(collapsed: Column) -> Column:
    return F.when(collapsed == "", 0).otherwise(F.size(F.split(collapsed, " ", -1)))


def distinct_ci(values: Column) -> Column:
    """The first of those that are equal but for case, in order: by sorting, and only where some are equal."""
    keyed = lambda vs: F.sort_array(F.transform(vs, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v"))))
    firsts = lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["k"] != x["k"]))
    ordered = lambda s: F.transform(F.sort_array(F.transform(firsts(s), lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"])
    return let(values, lambda vs: F.when(F.size(F.array_distinct(F.transform(vs, F.lower))) == F.size(vs), vs).otherwise(let(keyed(vs), ordered)))


def sentences(text: Column) -> Column:
    """Sentences of the collapsed text; none is empty."""
    return F.filter(F.split(collapse(text), r"(?<=[.!?]) +", -1), lambda s: s != "")


def items(text: Column, least: int = 3) -> Column:
    """Items of a document: cut at sentence ends, line breaks, bullets and numbers that open a line; three words or more; distinct but for case."""
    cut = rf"(?md)(?<=[.!?]){WS}+|\n+|^{WS}*[-•]{WS}+|^{WS}*(?U:\d)+[.)]{WS}+"
    parts = F.transform(F.split(unix_lines(text), cut, -1), collapse)
    return let(F.filter(parts, lambda p: word_count(p) >= least), distinct_ci)


def mail_sentences(body: Column, least: int = 3) -> Column:
    parts = F.transform(F.split(body, rf"(?<=[.!?]){WS}+|\n+", -1), lambda p: F.btrim(collapse(p), F.lit(" -•")))
    return let(F.filter(parts, lambda p: word_count(p) >= least), distinct_ci)


def has_all(values: Column, required: Iterable[str]) -> Column:
    """Whether all of the required values are there."""
    return F.size(F.array_except(words_array(required), values)) == 0


def numbered(values: Column) -> Column:
    """The values with their numbers from 1 on."""
    return F.transform(values, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def count_but(values: Column, sentinel: str) -> Column:
    """How many values there are that are not the sentinel."""
    return F.size(F.filter(values, lambda x: x != F.lit(sentinel)))


def tokens(text: Column, stop: Iterable[str] = lex.QUESTION_STOP_WORDS) -> Column:
    """Lower-case Latin or Arabic runs of two characters or more that are no stop words, repeats kept."""
    return lowered_tokens(F.lower(text), stop)


def lowered_tokens(lowered: Column, stop: Iterable[str] = lex.QUESTION_STOP_WORDS) -> Column:
    found, listed = F.regexp_extract_all(lowered, F.lit(r"[a-z0-9]{2,}|[\u0600-\u06FF]{2,}"), F.lit(0)), list(stop)
    return F.filter(found, lambda t: ~t.isin(listed))  # a set, where an array is searched word by word


#: Where a source is cut into passages; the characters that no cut begins with are seen first, as most are of them.
PASSAGE_CUT = rf"(?md)(?![!-,./0-~])(?:\n{{2,}}|(?<=[.!?؟]){WS}+|^{WS}*[-•]{WS}+)"


def passages_with_tokens(text: Column, least: int = 3) -> Column:
    """Passages of a source with their tokens, each read once: cut at blank lines, sentence ends and bullets, not at a
    single line break; three tokens or more; distinct but for case."""
    parts = F.transform(F.split(unix_lines(text), PASSAGE_CUT, -1), lambda p: F.btrim(collapse(p), F.lit(" -•")))
    read = F.filter(F.transform(parts, lambda p: F.struct(p.alias("passage"), tokens(p).alias("tokens"))), lambda x: F.size(x["tokens"]) >= least)
    return let(read, lambda r: let(distinct_ci(F.transform(r, lambda x: x["passage"])), lambda d: F.when(F.size(d) == F.size(r), r).otherwise(F.transform(d, lambda p: F.struct(p.alias("passage"), tokens(p).alias("tokens"))))))


def passage_tokens(text: Column, least: int = 3) -> Column:
    """The tokens of the passages alone, which are not made for that: those that are equal but for case have equal tokens,
    so that they are told apart only in a source where two hashes of tokens are equal."""
    plain = F.when(F.contains(text, F.lit("\r")), unix_lines(text)).otherwise(F.coalesce(text, F.lit("")))
    read = F.filter(F.transform(F.split(F.lower(plain), PASSAGE_CUT, -1), lambda p: lowered_tokens(p)), lambda t: F.size(t) >= least)
    told = F.transform(passages_with_tokens(text, least), lambda p: p["tokens"])
    return let(read, lambda r: let(F.transform(r, lambda t: F.xxhash64(t)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), r).otherwise(told)))


def passages(text: Column, least: int = 3) -> Column:
    """The passages of a source alone."""
    return F.transform(passages_with_tokens(text, least), lambda x: x["passage"])


def keywords(text: Column, stop: Iterable[str] = lex.COMPARISON_STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    listed = words_array(stop)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(listed, t)))


def numbers(text: Column) -> Column:
    """The distinct numbers as written: 5 and 5.0 are two, 1,000 gives 1 and 000."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\d+(?:\.\d+)?\b"), F.lit(0)))


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    """Whether one of the words is a substring; no word boundaries."""
    listed = words_array(words)
    return F.exists(listed, lambda k: F.contains(lowered, k))


def mentioning(parts: Column, words: Iterable[str]) -> Column:
    """The parts that mention one of the words."""
    return F.filter(parts, lambda s: let(F.lower(s), lambda low: contains_any(low, words)))


def found_words(lowered: Column, words: Iterable[str]) -> Column:
    return F.filter(words_array(words), lambda k: F.contains(lowered, k))


def labels_of(lowered: Column, labels: dict[str, str]) -> Column:
    """The labels of the keywords that occur, in the lexicon's order."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in labels.items()))
    return F.transform(F.filter(pairs, lambda p: F.contains(lowered, p["k"])), lambda p: p["v"])


def shorten(text: Column, limit: int = lex.SHORTEN) -> Column:
    """At most ``limit`` characters, cut at the last space among them, and three dots."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", ""), F.lit("...")))


def header(mail_lines: Column, label: str) -> Column:
    """The first header of that name. White space after the colon may cross a line end, so an empty one takes the next line."""
    return F.nullif(F.trim(F.regexp_extract(F.array_join(mail_lines, "\n"), rf"(?imd)^{label}{WS}*:{WS}*(.+)$", 1)), F.lit(""))


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def or_else(values: Column, *instead: str) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(words_array(instead))


def first_error(*rules: tuple[Column, str, str | Column]) -> tuple[Column, Column]:
    """(code, message) of the first rule that is broken, null if none is."""
    code = message = None
    for broken, name, text in rules:
        text = text if isinstance(text, Column) else F.lit(text)
        code = F.when(broken, F.lit(name)) if code is None else code.when(broken, F.lit(name))
        message = F.when(broken, text) if message is None else message.when(broken, text)
    return code, message
