"""The best passages of a corpus: both forms of the score agree, and the bounded search equals a full one."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import compare, qa, topk
from vellum.plans import catalog, corpus as whole, derived  # noqa: F401  queries

HINTS = {"fees": ["fee", "cost", "price"], "time": ["days", "hours"], "place": ["office", "portal"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["permit", "renewal", "form", "identity", "proof", "garden", "winter", "river", "fee", "cost", "days", "hours", "office", "portal", "stone", "letter"]
    told = lambda n: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n))
    sources = [(i if i != 11 else None, ". ".join(told(rng.randint(3, 9)) for _ in range(rng.randint(1, 5))) + ".") for i in range(120)] + [(500, ""), (501, None), (502, "fee office days. fee office days too.")]
    questions = [(i, told(rng.randint(1, 8)) + "?") for i in range(25)] + [(90, ""), (91, "the of"), (92, None), (93, "price hours portal"), (94, "nothing here occurs")]
    return spark.createDataFrame(questions, "q long, question string").repartition(2), spark.createDataFrame(sources, "s long, body string").repartition(6)


def test_both_forms_score_alike(corpus):
    questions, sources = corpus
    inverted = {(r["q_id"], r["s_id"], r["pos"]): (r["score"], r["shared"]) for r in qa.corpus_scores(questions, sources.where("s is not null"), "q", "question", "s", "body", HINTS).collect()}
    pairs = questions.crossJoin(sources.where("s is not null")).withColumn("t", F.array_distinct(T.tokens(T.collapse(F.col("question")))))
    one = pairs.where(F.size("t") > 0).select("q", "s", F.posexplode(T.passages_with_tokens(F.col("body"))).alias("pos", "p"), "t").select("q", "s", "pos", qa.score_of(F.col("t"), F.col("p.tokens"), HINTS).alias("x"))
    single = {(r["q"], r["s"], r["pos"]): (r["x"]["score"], r["x"]["shared"]) for r in one.collect() if r["x"]["score"] > 0}
    assert inverted == single and len(single) > 1000


@pytest.mark.parametrize("k,terms,pairs", [(1, 10**6, 1 << 18), (3, 10**6, 50), (5, 40, 1 << 18)])
def test_bounded_search_equals_a_full_one(corpus, monkeypatch, k, terms, pairs):
    """Ties, sources without an id, questions in groups, and few pairs at once."""
    monkeypatch.setattr(topk, "PAIRS", pairs)
    questions, sources = corpus
    got = [(r["q_id"], r["rank"], r["s_id"], r["pos"], r["score"], r["n_shared"]) for r in qa.corpus_top(questions, sources, "q", "question", "s", "body", HINTS, k, terms).collect()]
    full = {}
    numbered = sources.withColumn("s", F.coalesce("s", F.lit(-1)))
    for r in qa.corpus_scores(questions, numbered, "q", "question", "s", "body", HINTS).collect():
        full.setdefault(r["q_id"], []).append((-r["score"], r["s_id"], r["pos"], len(r["shared"])))
    expected = [(q, i, by, -s, n) for q, rows in full.items() for i, (s, src, by, n) in enumerate(sorted(rows, key=lambda x: x[:3])[:k], 1)]
    assert sorted((q, i, p, s, n) for q, i, _, p, s, n in got) == sorted(expected)
    assert sorted((q, -1 if x is None else x) for q, _, x, _, _, _ in got) == sorted((q, src) for q, rows in full.items() for _, src, _, _ in sorted(rows, key=lambda x: x[:3])[:k])


def test_scores_rise_and_common_terms_drop_out():
    """With k passages that share all terms, only a question's rarest term is still looked for."""
    questions = topk.Questions([1], [["a", "b", "c", "d"]], {}, 3)
    best = topk.Best(questions, 2)
    place = {t: i for i, t in enumerate(questions.vocabulary)}
    tokens = [["a", "b", "c", "d"]] * 2 + [["a", "b"]] * 3
    best.take([(True, i) for i in range(5)], topk.np.arange(5), topk.np.array([place[t] for x in tokens for t in x]), topk.np.repeat(topk.np.arange(5), [len(x) for x in tokens]))
    assert best.needed().tolist() == [4]
    assert best.essential()[0].tolist() in ([place["c"]], [place["d"]])
    assert [r[:3] for r in best.rows[0]] == [(-1.0, (True, 0), 0), (-1.0, (True, 1), 1)]


@pytest.mark.parametrize("first,dense,hints", [(1 << 11, 8, HINTS), (50, 0, HINTS), (1 << 11, 8, {})])
def test_few_pairs_are_scored(monkeypatch, first, dense, hints):
    """Pairs are added up by terms; only those that can still get in are scored one by one, and none is missed."""
    np, rng = topk.np, random.Random(7)
    words = [f"w{i}" for i in range(60)] + [w for x in HINTS.values() for w in x]
    told = lambda n: rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n)
    questions = topk.Questions(list(range(40)), [sorted(set(told(rng.randint(1, 25)))) if i else [] for i in range(40)], hints, 3)
    place, passages = {t: i for i, t in enumerate(questions.vocabulary)}, [told(rng.randint(3, 14)) for _ in range(6000)]
    passages = [[t for t in x if t in place] for x in passages]
    scored, score = [], topk.Best._score
    monkeypatch.setattr(topk.Best, "_score", lambda self, p, *rest: (scored.append(len(p)), score(self, p, *rest))[1])
    monkeypatch.setattr(topk, "FIRST", first, raising=False)
    monkeypatch.setattr(topk, "DENSE", dense, raising=False)
    best = topk.Best(questions, 3)
    for lo in range(0, len(passages), 2000):
        some = passages[lo : lo + 2000]
        best.take([(True, lo + i) for i in range(len(some))], np.zeros(len(some), np.int64), np.array([place[t] for x in some for t in x], np.int64), np.repeat(np.arange(len(some)), [len(x) for x in some]))
    got = {}
    for q, source, _, value, shared in best.finish():
        got.setdefault(q, []).append((-value, source[1], shared))
    met = 0
    for q in range(40):
        asked = {questions.vocabulary[i] for i in questions.terms[questions.lo[q] : questions.lo[q + 1]]}
        rows = []
        for i, x in enumerate(passages):
            common, both = asked & set(x), sum(bool(asked & set(w)) and bool(set(x) & set(w)) for w in hints.values())
            met += bool(common)
            if common or both:
                rows.append((-float(questions.score(np.array([len(common)]), np.array([len(asked)]), np.array([both]), np.array([sum(min(3, x.count(t)) for t in common)]))[0]), i, len(common)))
        assert sorted(got.get(q, [])) == sorted(rows)[:3]
    assert sum(scored) < met / 10


def test_tokens_of_passages_alone(spark):
    """The same as with the passages, those that are equal but for case included; stop words are looked up in a set."""
    texts = ["Fee for a new permit. fee FOR a new Permit.\n\n- Fee for a new permit.  Other words stand here!", "One two three four. One two three, four. One two; three four.", "İstanbul ΟΔΟΣ office fee. ΟΔΟΣ. İSTANBUL office fee K days.", "الرسوم خمسة دنانير؟ الرسوم خمسة دنانير؟ a b c", "", None, "too short. x y z"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    told = rows.select("i", T.passage_tokens(F.col("x")).alias("alone"), F.transform(T.passages_with_tokens(F.col("x")), lambda p: p["tokens"]).alias("beside")).collect()
    assert all(r["alone"] == r["beside"] for r in told) and [len(r["alone"]) for r in sorted(told)] == [2, 3, 2, 1, 0, 0, 0]
    plan = rows.select(T.tokens(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan


def test_answers_without_support(corpus):
    questions, sources = corpus
    rows = qa.corpus_answers(qa.corpus_top(questions, sources, "q", "question", "s", "body", HINTS), questions, "q").collect()
    assert {r["q_id"] for r in rows} == {r["q"] for r in questions.collect()}
    none = [r for r in rows if r["q_id"] in (90, 91, 92, 94)]
    assert all(r["status"] == qa.NOT_FOUND and r["rank"] is None and r["s_id"] is None for r in none) and len(none) == 4


def test_pairs_are_made_where_passages_lie(spark):
    """All pairs need no shuffle, and questions in several groups give the same as in one."""
    q = spark.createDataFrame([(1, "red apple tree"), (2, "apple pie, red apple pie"), (3, "of the"), (None, "red"), (4, "green")], "q int, question string")
    d = spark.createDataFrame([(7, "A red apple apple apple apple fell. The tree is red tonight."), (8, None), (None, "Green pie for nobody here.")], "s int, body string")
    told = lambda terms: sorted(map(str, qa.corpus_scores(q, d, "q", "question", "s", "body", {}, terms).collect()))
    assert told(100) == told(2) and len(told(100)) == 6
    for made in (qa.corpus_scores(q, d, "q", "question", "s", "body", {}), qa.corpus_overlap(q, d, "q", "question", "s", "body")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_places_and_figures_need_no_texts(spark):
    """Comparisons by keywords that tell places and figures give the same without the texts of items, which are then not shuffled."""
    docs = spark.createDataFrame([(1, "The fee is 5 dollars now. Apply for the permit online."), (2, "The fee is 7 dollars now. Nothing else matters here."), (3, "")], "doc_id long, text string")
    sides = F.array(*(F.struct((F.col("doc_id") - n).alias("pair_id"), F.lit(x).alias("side")) for n, x in ((0, "a"), (1, "b"))))
    by = {"text_weight": 0.0, "keyword_weight": 1.0}
    full, bare = (compare.item_sides(docs, sides, texts=x) for x in (True, False))
    assert {i for r in bare.collect() for i in [*r["a_items"], *r["b_items"]]} == {None}
    assert sorted(compare.pair_figures(full, "pair_id", **by).collect()) == sorted(compare.pair_figures(bare, "pair_id", **by).collect()) != []
    place = lambda x: sorted(map(str, compare.compare_items(x, "pair_id", **by).drop("a_item", "b_item").collect()))
    assert place(full) == place(bare) != []
    assert sorted(compare.extra_items(full, "pair_id", **by).select("pair_id", "b_pos").collect()) == sorted(compare.extra_items(bare, "pair_id", **by).select("pair_id", "b_pos").collect())


def test_no_filter_is_moved_before_the_shuffle(spark, sf_dir):
    """A table of one file is dealt out before texts are read: a filter on results runs after it, in many tasks, and what it tests is made once."""
    plan = catalog.QUERIES["qa_document_answers"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Repartition" in line)
    assert any("Filter" in line for line in plan[:at]) and not any("Filter" in line for line in plan[at:])
    assert sum("؟" in line for line in plan) == 1  # the cut of passages


def test_best_passage_beside_an_answer(spark):
    rows = spark.createDataFrame([("The fee is five dinars. Forms are at the desk.", "which fee is asked"), ("no words alike in here", "zebra crossing"), (" ", "x")], "source_text string, question string")
    told = [r["best"] and (r["best"]["passage"], r["best"]["shared_terms"]) for r in qa.answer_questions(rows, best="best").collect()]
    assert told == [("The fee is five dinars.", ["fee"]), ("no words alike in here", []), None]
    assert "best" not in qa.answer_questions(rows).columns
