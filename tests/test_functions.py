"""Text functions against plain Python statements of their rules, on random texts."""

import datetime
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import lexicons as lex, numbers as N, text as T
from vellum.operators import compare, email, qa

PIECES = ["Hello world.", "a b c", "\n", "\r\n", "\r", "  ", "\t", " ", "- item one two", "• three four five", "1. first of all", "2) second is this", "Yes! No? ok", "عربي نص هنا؟", "٥ days", "5 days", "x" * 190, "The THE the end.", "\n\n", "From: a b", "Thanks,", "must review it now please", "by tomorrow we meet", "café 3/4", "\x1c", " . "]


def random_texts(n=300):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def pieces(t, splits):
    """The text cut by a scanner: ``splits`` tells for a place how many characters to leave out there (0: none)."""
    out, at, begin = [], 0, 0
    while at < len(t):
        n = splits(t, at)
        if n:
            out.append(t[begin:at])
            at += n
            begin = at
        else:
            at += 1
    return [*out, t[begin:]]


def spaces(t, at):
    """White space from a place on."""
    n = 0
    while at + n < len(t) and t[at + n].isspace():
        n += 1
    return n


def after_end(t, at, ends=".!?"):
    return spaces(t, at) if at and t[at - 1] in ends else 0


def bullet(t, at):
    """A bullet that opens a line, with the white space around it."""
    if at and t[at - 1] != "\n":
        return 0
    n = spaces(t, at)
    if at + n < len(t) and t[at + n] in "-•" and (more := spaces(t, at + n + 1)):
        return n + 1 + more
    return 0


def number(t, at):
    """A number with a point or bracket that opens a line."""
    if at and t[at - 1] != "\n":
        return 0
    n = first = spaces(t, at)
    while at + n < len(t) and t[at + n].isdecimal():
        n += 1
    if n > first and at + n < len(t) and t[at + n] in ".)" and (more := spaces(t, at + n + 1)):
        return n + 1 + more
    return 0


def newlines(t, at, least=1):
    n = len(t[at:]) - len(t[at:].lstrip("\n"))
    return n if n >= least else 0


def words_of(t):
    return "".join(" " if c.isspace() else c for c in t).split(" ")


def joined(t):
    return " ".join(w for w in words_of(t) if w)


def once(values):
    """The first of values that differ by more than case."""
    return [v for i, v in enumerate(values) if all(v.lower() != w.lower() for w in values[:i])]


def unix(t):
    return "".join("" if c == "\r" and t[i + 1 : i + 2] == "\n" else "\n" if c == "\r" else c for i, c in enumerate(t))


def item_rule(t):
    found = pieces(unix(t), lambda u, at: after_end(u, at) or newlines(u, at) or bullet(u, at) or number(u, at))
    return once([p for p in map(joined, found) if len(p.split(" ")) >= 3])


def runs(t, inside):
    """Maximal runs of characters of a kind; a kind is a number, 0 is none."""
    out, last = [], 0
    for c in t:
        kind = inside(c)
        if kind and kind == last:
            out[-1] += c
        elif kind:
            out.append(c)
        last = kind
    return out


LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def token_rule(t):
    return [x for x in runs(t.lower(), lambda c: 1 if c in LATIN else 2 if 0x600 <= ord(c) <= 0x6FF else 0) if len(x) > 1 and x not in lex.QUESTION_STOP_WORDS]


def passage_rule(t):
    found = pieces(unix(t), lambda u, at: newlines(u, at, 2) or after_end(u, at, ".!?؟") or bullet(u, at))
    return once([p for p in (joined(x).strip(" -•") for x in found) if len(token_rule(p)) >= 3])


def body_rule(t):
    kept = []
    for line in filter(None, map(joined, unix(t).split("\n"))):
        name, colon, _ = line.lower().partition(":")
        if colon and name.strip() in {"from", "to", "cc", "bcc", "subject", "date", "sent"}:
            continue
        bare = line.lower()
        if (bare[:-1] if bare[-1] in ",!" else bare) in {"regards", "best regards", "kind regards", "thanks", "thank you"}:
            break
        kept.append(line)
    return " ".join(kept)


def short_rule(t):
    if len(t) <= 180:
        return t
    cut = max((i for i in range(180) if t[i] == " "), default=180)
    return t[:cut] + "..."


def number_rule(t):
    """Digits with at most one point and more digits, no letter, digit or underscore beside them."""
    wordy, found, at = (lambda c: c.isalnum() or c == "_"), set(), 0
    while at < len(t):
        if t[at].isdecimal() and not (at and wordy(t[at - 1])):
            end = at
            while end < len(t) and t[end].isdecimal():
                end += 1
            more = end + 1
            while more < len(t) and t[end] == "." and t[more].isdecimal():
                more += 1
            if end < len(t) and t[end] == "." and more > end + 1 and not (more < len(t) and wordy(t[more])):
                end = more
            if end == len(t) or not wordy(t[end]):
                found.add(t[at:end])
                at = end
                continue
        at += 1
    return sorted(found)


DUE = [("Send by tomorrow", True), ("by  EOD then", True), ("by end of week", True), ("TODAY", True), ("next week or so", True), ("todayish", False), ("by Friday", False), ("end of week", False), ("3/4", True), ("2026-08-01", True), ("by 5-6-26", True), ("1.2", False), ("١/٢ it is", True), ("v3/4", False), ("", False)]


RULES = {
    "collapse": (T.collapse, joined),
    "sentences": (T.sentences, lambda t: [x for x in pieces(joined(t), after_end) if x]),
    "items": (T.items, item_rule),
    "tokens": (T.tokens, token_rule),
    "passages": (T.passages, passage_rule),
    "passage tokens": (lambda c: F.transform(T.passages_with_tokens(c), lambda p: F.array_join(p["tokens"], " ")), lambda t: [" ".join(token_rule(p)) for p in passage_rule(t)]),
    "numbers": (lambda c: F.array_sort(T.numbers(c)), number_rule),
    "keywords": (lambda c: F.array_sort(T.keywords(c)), lambda t: sorted({x for x in runs(t.lower(), LATIN.__contains__) if len(x) > 2 and x not in lex.COMPARISON_STOP_WORDS})),
    "body": (lambda c: email.body_of(T.lines(c)), body_rule),
    "shorten": (T.shorten, short_rule),
    "distinct": (lambda c: T.distinct_ci(F.split(c, " ")), lambda t: once(t.split(" "))),
    "numbered": (lambda c: T.numbered(F.split(c, " ")), lambda t: [f"{i}. {x}" for i, x in enumerate(t.split(" "), 1)]),
    "hints": (lambda c: qa.hints_of(T.tokens(c)), lambda t: [k for k, v in lex.QUESTION_HINTS.items() if set(v) & set(token_rule(t))]),
}


def test_deadlines(spark):
    got = spark.createDataFrame(DUE, "t string, due boolean").select("due", (F.size(email.deadlines_of(F.array("t"))) > 0).alias("found"), "t").collect()
    assert [(r.t, r.found) for r in got] == DUE


@pytest.mark.parametrize("rule", RULES)
def test_rule(spark, rule):
    ours, plain = RULES[rule]
    texts = random_texts()
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", ours(F.col("t")).alias("x")).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert r.x == plain(t), repr(t)


def test_numbers(spark):
    cases = [("1,200", 1200.0), ("1_000", 1000.0), ("1d", None), ("1f", None), ("٥", 5.0), (" 2.5 ", 2.5), ("1__0", None), ("", None), ("-3e2", -300.0), ("abc", None)]
    got = spark.createDataFrame([(c,) for c, _ in cases], "c string").select(N.to_number(F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in cases] == [N.plain_number(c) for c, _ in cases]
    assert N.plain_day(" 2026-8-1 ") == datetime.date(2026, 8, 1)
    days = [("2026-8-1", True), ("2026-02-30", False), ("2026/08/01", False), ("2026-12-31", True), ("", False)]
    assert [r.d is not None for r in spark.createDataFrame([(c,) for c, _ in days], "c string").select(N.to_day(F.col("c")).alias("d")).collect()] == [ok for _, ok in days]
    assert [r.p for r in spark.createDataFrame([(1, 8), (3, 8), (4, 9), (0, 0)], "a int, b int").select(N.percent_of(F.col("a"), F.col("b")).alias("p")).collect()] == [12, 38, 44, None]
    values = [2.675, 0.1235, 0.5, 0.0625, 1.0, 0.16]
    assert [r.r for r in spark.createDataFrame([(v,) for v in values], "v double").select(N.rounded(F.col("v"), 2).alias("r")).collect()] == [round(v, 2) for v in values]


def test_pruned_search_equals_the_full_one():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    for _ in range(60):
        own = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(4)]
        other = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(8)] + own[:1]
        keys = lambda x: set(x.split())
        for item in own:
            best, score = None, 0.0
            for j, o in enumerate(other):
                s = 0.65 * difflib.SequenceMatcher(None, item, o).ratio() + 0.35 * (len(keys(item) & keys(o)) / min(len(keys(item)), len(keys(o))))
                if s > score:
                    best, score = j, s
            assert compare.best_of(item, keys(item), other, [keys(o) for o in other]) == (best, score)


def test_items_below_the_bar_are_left_without_a_full_search(monkeypatch):
    """Texts are told apart by common subsequences with all others at once; blocks are looked for only where a pair may count."""
    rng, steps = random.Random(3), []
    plain = compare.Target.step
    monkeypatch.setattr(compare.Target, "step", lambda *a: (steps.append(1), plain(*a)))
    text = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(1, 150)))
    items, others = [text() for _ in range(20)], [text() for _ in range(40)] + ["", "x" * 300]
    items[3], items[4] = others[7], others[9] + "y"
    shares, ready = np.zeros((20, 42)), compare.Others(others)
    full = compare.best_of_all(items, ready, shares, 0.65, 0.35)
    many = len(steps)
    barred = compare.best_of_all(items, ready, shares, 0.65, 0.35, 0.44)
    assert len(steps) - many < many / 5
    assert [b for b, f in zip(barred, full, strict=True) if f[1] >= 0.44] == [f for f in full if f[1] >= 0.44] != []
    assert all(b in (f, (None, 0.0)) for b, f in zip(barred, full, strict=True))
    for text in items[:5]:
        common = compare.Meeting(ready, text).common.tolist()
        for other, n in zip(others, common, strict=True):
            row = [0] * (len(other) + 1)
            for c in text:
                last = 0
                for j, o in enumerate(other, 1):
                    last, row[j] = row[j], last + 1 if c == o else max(row[j], row[j - 1])
            assert row[-1] == n


def test_blocks_are_those_of_the_library_in_few_steps(monkeypatch):
    """Stretches without a run of three are gone through in one step; a stretch inside both texts has a closer bound than its length."""
    rng, steps = random.Random(7), []
    plain = compare.Target.step
    monkeypatch.setattr(compare.Target, "step", lambda *a: (steps.append(1), plain(*a)))
    for _ in range(300):
        letters = rng.choice(["ab", "abc ", "abcdefghijklmnopqrstuvwxyz  "])
        text = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 20, 90, 199, 200, 260])))
        a, b = text(), text()
        b += a[: rng.randint(0, 60)] if rng.random() < 0.4 else ""
        assert compare.Target(b).matched(a) == sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        (a_lo, a_hi), (b_lo, b_hi) = (sorted(rng.randint(0, len(x)) for _ in "ab") for x in (a, b))
        room = compare.Meeting(compare.Others([b]), a).room(0, a_lo, a_hi, b_lo, b_hi)
        assert min(a_hi - a_lo, b_hi - b_lo) >= room >= sum(x.size for x in difflib.SequenceMatcher(None, a[a_lo:a_hi], b[b_lo:b_hi], False).get_matching_blocks())
    steps.clear()
    assert compare.Target("a-b-c-d-e-f-g-h").matched("a.b.c.d.e.f.g.h") == 8 and len(steps) == 1
    assert compare.Meeting(compare.Others(["k" + "x" * 9 + "k"]), "k" + "y" * 9 + "k").room(0, 1, 10, 1, 10) == 0
