"""The operators on conversations and benchmark windows against plain Python, with every odd case."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tests.llm import brute, brute_conversations as plain
from vellum.llm import conversation_repair as repair, conversation_trie as trie, decontamination as clean

SCHEMA = "conv_id long, turn long, role string, text string"


def told(seed=3, n=60):
    """Conversations with nulls, blanks, repeats, other roles, gaps, ties, copies, negative and null ids."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -10, None, 10**12]:
        for t in range(rng.choice([1, 2, 2, 3, 4, 5, 6])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "Is it?", "cut short", "", " \t\n", "\x0b\x0c", None, "Yes.", "A. b \x0b", "é!", "中文。", "x" * 50 + "."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    copy = [(t, r, x) for c, t, r, x in rows if c == 5]
    return rows + [(200 + k, *x) for k in range(7) for x in copy]


def wide(df):
    return df.withColumns({c: F.lit(c) for c in ("c", "step", "key", "block", "copies", "depth", "n", "what", "state", "spans", "items")})


def test_repairs(spark):
    rows = told()
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in repair.damaged_repairs(wide(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()}
    assert got == plain.repairs(rows)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", ""]), st.sampled_from(["A.", "B.", "C!", "cut", " "])), max_size=6))
@settings(max_examples=150, deadline=None)
def test_least_cost_and_audit(turns):
    """One query of the operator against all edits tried."""
    rows = [(i, r, t) for i, (r, t) in enumerate(turns)]
    batch = pa.RecordBatch.from_pydict({"conv_id": [1] * max(1, len(rows)), "turn": [t for t, _, _ in rows] or [None], "role": [r for _, r, _ in rows] or [None], "text": [x for _, _, x in rows] or [None], "copies": [1] * len(rows) or [0]}, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32())]))
    out = next(repair._repair(iter([batch]))).to_pylist()[0]
    cost, audit, kept = plain.cheapest(rows, plain.faults(rows))
    assert (out["cost"], out["audit"]) == (cost, audit)
    assert [(x["role"], x["text"]) for x in out["repaired"]] == kept


def test_batches_hold_whole_conversations(spark, monkeypatch):
    """Small batches, and one conversation longer than a batch, give what one batch gives."""
    rows = [(c, t, "user" if t % 2 else "assistant", f"{t}{'.' * (t % 3)}") for c, n in ((1, 3), (2, 90), (3, 1), (4, 12), (9, 2)) for t in range(n)]
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32())])
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*(r + (1,) for r in rows)), schema)], schema)
    whole = [r for b in repair._repair(iter(table.to_batches())) for r in b.to_pylist()]
    monkeypatch.setattr(repair, "BATCH_ROWS", 10)
    assert [r for b in repair._repair(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()] == whole
    assert [r["conv_id"] for r in whole] == [1, 2, 3, 4, 9]


def nodes(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def test_trie_of_rebuilt_conversations(spark):
    rows = [r for r in told(11) if r[0] is None or r[0] >= 0]
    assert nodes(trie.rebuilt_trie(wide(spark.createDataFrame(rows, SCHEMA).repartition(4)))) == plain.trie(plain.rebuilt(rows))


@pytest.mark.parametrize("shape", ["random", "chain", "copies", "flat"])
def test_trie_over_many_blocks(spark, monkeypatch, shape):
    """More blocks than runs of equal conversations, few of them a round, chunks of few ids."""
    rng = random.Random(shape)
    told = {
        "random": {c: [(rng.choice("ua"), rng.choice(["", "x", "é"])) for _ in range(rng.randint(1, 6))] for c in range(150)},
        "chain": {c: [("u", str(k)) for k in range(c % 30 + 1)] for c in range(90)},
        "copies": {c: [("u", "a")] * (3 if c % 9 else 5) for c in range(200)},
        "flat": {c: [("u", str(c))] for c in range(50)},
    }[shape]
    rows = [(c, t, r, x) for c, turns in told.items() for t, (r, x) in enumerate(turns)]
    monkeypatch.setattr(trie, "CHUNK", 7)
    monkeypatch.setattr(trie, "partitions", lambda spark: 9)
    assert nodes(trie.prefix_trie(trie.conversation_strings(spark.createDataFrame(rows, SCHEMA)), fan=2)) == plain.trie(told)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(docs, items):
    windows = {}
    for i, text in items:
        w = WORD.findall(brute.lower(text or ""))
        for k in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = {}
    for d, text in docs:
        w, found, hit = WORD.findall(brute.lower(text or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out[d] = {"n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": brute.sha(",".join(sorted(found))), "contaminated": bool(hit)}
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(2)
    docs = brute.documents()
    long = [t for _, t in docs if t and len(t.split()) > 40]
    items = [(k, " ".join(rng.choice(long).split()[3 : 3 + rng.randint(1, 30)])) for k in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, "a"), (104, "中文"), (105, "É é"), (106, items[0][1].upper()), (106, "Alpha1! beta2"), (None, items[1][1]), (3, items[3][1])]
    docs += [(900, items[0][1].upper().replace(" ", " -- ")), (901, "x" + items[0][1]), (902, "the a b"), (903, "中文 É É é"), (904, items[2][1] + " " + items[2][1])]
    return docs, items


@pytest.mark.parametrize("item_bytes", [clean.ITEM_BYTES, 900])
def test_benchmark_windows(spark, leaks, item_bytes):
    """In one group of items, and in groups searched one after another."""
    docs, items = leaks
    frame = wide(brute.frame(spark, docs)).repartition(3)
    found = clean.benchmark_hits(frame, spark.createDataFrame(items, "item_id long, text string"), item_bytes).collect()
    expected = hits(docs, items)
    got = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), brute.sha(",".join(r["items"]))) for r in found}
    assert got == {d: (x["n_words"], x["n_hit"], x["items_sha256"]) for d, x in expected.items()}
    rows = clean.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in rows} == expected


@given(st.lists(st.text(alphabet="aAbB z09é.-\n", max_size=40), max_size=5), st.lists(st.text(alphabet="aAbB z09é.-\n", max_size=14), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_windows_in_small_alphabets(texts, items):
    search = clean.Search([str(i) for i in range(len(items))], items)
    spaced = clean.Spaced(pa.array(texts, pa.string()))
    edges = clean.np.zeros(len(spaced.doc) + 1, "int64")
    pairs = search(spaced, len(texts), edges)
    doc, start, end = clean._spans(spaced, edges)
    expected = hits(list(enumerate(texts)), list(enumerate(items)))
    for d in range(len(texts)):
        assert (int(spaced.count[d]), int((end - start)[doc == d].sum()), int((pairs // len(items) == d).sum())) == tuple(expected[d][k] for k in ("n_words", "n_hit", "n_items"))


def test_long_shared_bucket(spark, monkeypatch):
    """Windows that end alike are compared a part at a time."""
    monkeypatch.setattr(clean, "COMPARED", 5)
    items = [(str(i), f"w{i:03d} one two three four five six seven eight nine") for i in range(60)]
    text = " ".join(x for _, x in items[::7])
    spaced = clean.Spaced(pa.array([text]))
    pairs = clean.Search(*map(list, zip(*items)))(spaced, 1, clean.np.zeros(len(spaced.doc) + 1, "int64"))
    assert len(pairs) == len(items[::7])


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, text string")
    assert repair.damaged_repairs(none).count() == trie.rebuilt_trie(none).count() == 0
    assert clean.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    got = clean.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]
