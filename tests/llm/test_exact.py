"""Operators whose result is fixed, against plain Python, over every odd case; and each over an empty table."""

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm import brute
from vellum.llm import bpe, common, fingerprints, jaccard, packing, quality_rules, secrets, substring, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(alphabet="aabTHE stre'\n\t\x0b\x0c\x1c\x85 ​ÉéßΣς中😀12٣_-#$<|endoftext>ſ́İ.!?", max_size=80)


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.frame(spark, rows).repartition(5)


def collected(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@given(st.lists(ODD, max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_and_hashes(texts):
    w = common.Words(pa.array(texts, pa.string()), fold=True)
    got = [[] for _ in texts]
    for s, e, d in zip(w.starts, w.ends, w.doc):
        got[d].append(bytes(w.data[s:e]).decode())
    assert got == [brute.words(t) for t in texts]
    known = {}
    for h, x in zip(w.hashes().tolist(), [brute.lower(x) for t in texts for x in brute.words(t)]):
        assert known.setdefault(x, h) == h
    assert len(set(known.values())) == len(known)


@given(st.lists(ODD, max_size=8))
@settings(max_examples=80, deadline=None)
def test_bpe_equals_the_library(texts):
    library = Tokenizer.from_file(BYTE)
    own = bpe.load(BYTE)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text


@given(st.lists(ODD, max_size=8))
@settings(max_examples=80, deadline=None)
def test_word_ids_equal_the_library(texts):
    library = Tokenizer.from_file(WORD)
    for text, (ids, ends) in zip(texts, packing.load(WORD).encode(pa.array(texts, pa.string()))):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert not len(ends) or ends[-1] <= len(ids)


def test_bpe_query(docs, rows):
    library = Tokenizer.from_file(BYTE)
    got = collected(bpe.bpe_digests(docs, BYTE))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": brute.sha(library.decode(ids, skip_special_tokens=False))}
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in rows}


def test_packing_query(docs, rows):
    library = Tokenizer.from_file(WORD)
    pieces = packing.pack_documents(docs, WORD).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    at, used = dict.fromkeys(ids, 0), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(ids[p["doc_id"]])
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == p["length"] > 0
        at[p["doc_id"]] += p["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == used.get(p["sequence_id"], 0)
        used[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(used.values()) <= 2048
    assert sum(2048 - n for n in used.values() if n & (n - 1)) <= 0.05 * sum(used.values())


def cheapest(total, sentence, document, window):
    """The plain programme over every position."""
    fee = [packing.FREE_CUT] * (total + 1)
    for p in sentence:
        fee[p] = packing.SENTENCE_CUT
    for p in document:
        fee[p] = 0
    fee[total] = 0
    best = [0]
    for b in range(1, total + 1):
        best.append(min(best[a] + window - (b - a) + fee[b] for a in range(max(0, b - window), b)))
    return best[total], fee


@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 2)), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_cuts_are_the_cheapest_of_all_positions(parts):
    """Against a programme that may cut at every id; stretches without any end are longer than a window."""
    ends = np.cumsum([n for n, _ in parts])
    total, window = int(ends[-1]), 32
    sentence, document = ([int(e) for e, (_, k) in zip(ends, parts) if k == kind] for kind in (1, 2))
    found = packing.cuts(total, np.array(sentence, int), np.array(document, int), window)
    best, fee = cheapest(total, sentence, document, window)
    assert found[-1] == total and all(0 < b - a <= window for a, b in zip([0, *found[:-1]], found))
    assert sum(window - (b - a) + fee[b] for a, b in zip([0, *found[:-1]], found)) == best


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=60), st.integers(1, 200))
@settings(max_examples=60, deadline=None)
def test_windows_of_a_stream_are_those_of_the_whole(documents, run):
    """Windows given out early are the cheapest ones of the whole stream."""
    old, packing.RUN_IDS = packing.RUN_IDS, run
    try:
        packer, pieces, sentence, ends, total = packing.Packer(32, 1, 0), [], [], [], 0
        for i, (n, step) in enumerate(documents):
            own = np.arange(step, n, step)
            pieces += packer.add(i, np.arange(n), own)
            sentence += (own + total).tolist()
            total += n + 1
            ends.append(total)
        pieces += packer.flush(last=True)
    finally:
        packing.RUN_IDS = old
    best, fee = cheapest(total, sentence, ends, 32)
    sizes = {}
    for _, _, n, _, _, k, at, _ in pieces:
        assert at == sizes.get(k, 0)
        sizes[k] = at + n
    assert sum(sizes.values()) == total and max(sizes.values()) <= 32
    places = np.cumsum([sizes[k] for k in sorted(sizes)]).tolist()
    last = max(i for i in range(len(places)) if i == 0 or all(sizes[k] & (sizes[k] - 1) == 0 for k in range(i, len(places))) or i == len(places) - 1)
    first = next(i for i in range(len(places)) if all(sizes[k] & (sizes[k] - 1) == 0 for k in range(i, len(places)))) if sizes[len(places) - 1] & (sizes[len(places) - 1] - 1) == 0 else last
    costs = []
    for i in range(first, len(places)):  # where the sequences of the last window begin is not told: one of these places
        begin = places[i - 1] if i else 0
        if total - begin <= 32:
            costs.append(sum(32 - (b - a) + fee[b] for a, b in zip([0, *places[: i - 1]], places[:i])) + 32 - (total - begin))
    assert best in costs


def test_substring_query(docs, rows):
    expected = brute.repeats(rows)
    got = collected(substring.repeat_digests(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: (n, g, brute.sha(" ".join(k))) for i, (n, g, k) in expected.items()}
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns
    texts = dict(rows)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: " ".join(k) if g else texts[i] for i, (_, g, k) in expected.items()}
    spans = substring.repeated_spans(docs).collect()
    assert {i: sum(s["end"] - s["start"] for s in spans if s["doc_id"] == i) for i in texts} == {i: g for i, (_, g, _) in expected.items()}


def test_substring_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text), (3, text), (3, text), (3, "b " + text), (9, text + " x")]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.repeat_digests(brute.frame(spark, rows)).collect())
    assert got == [(False, 0, 25, 0), (True, 3, 25, 25), (True, 3, 25, 25), (True, 3, 26, 25), (True, 9, 26, 25)]


def test_jaccard_query(docs, rows):
    got = collected(jaccard.jaccard_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.components(rows)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    expected = brute.components(rows)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (n, c) in expected.items() if not n or c == i}


def test_jaccard_chain(spark):
    """A chain of sets, each near the next only, is one component; what shares a passage only is none."""
    w = [f"w{i}" for i in range(400)]
    rows = [(50 - i, " ".join(w[8 * i : 8 * i + 120])) for i in range(20)] + [(200 + i, " ".join([f"own{i}_{j}" for j in range(60)] + w[:50])) for i in range(20)] + [(7, None)]
    got = collected(jaccard.jaccard_components(brute.frame(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.components(rows)


def test_jaccard_past_an_empty_round(spark):
    """Near texts whose columns have a text of another size as pivot: no pair of the first round, yet a link."""
    rng, rows = np.random.default_rng(8), []
    while len(rows) < 60:
        w = [f"w{x}" for x in rng.integers(0, 2**40, 14)]
        three = [" ".join(w[:13]), " ".join(w[:12] + w[13:]), " ".join(w[:10])]
        row, value = jaccard.shingle_sets(pa.array(three, pa.string()))
        _, node = jaccard.set_ids(row, value, 3)
        shown = [set(value[row == i][:2].tolist()) for i in range(3)]
        if shown[0] == shown[1] == shown[2] and node[2] < min(node[0], node[1]):
            rows += [(len(rows) + i, t) for i, t in enumerate(three)]
    got = collected(jaccard.jaccard_components(brute.frame(spark, rows)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.components(rows)
    assert all(got[i + 1]["component_id"] == i for i in range(0, 60, 3))


def test_secrets_query(spark, rows):
    key = "ghp_Zz91kLmN0pQrStUvWx" + "7"
    more = [(1000, f'password = "abcdEFGH1234_x" and AKIA{"Z9" * 10} é {"ab12" * 5}'), (1001, f"é {key} here"), (1002, "Token: short, secret=token: abcdefghijklmnop"), (1003, None)]
    more += [(1010 + i, f"bare copy_of_1_example_key_2 in {i}") for i in range(12)]
    every = rows + more
    got = collected(secrets.secret_report(brute.frame(spark, every)))
    for i, t in every:
        spans = brute.secrets(t)
        written = [f"{n}:{a}:{b}" for a, b, n in spans]
        assert got[i]["base_sha256"] == brute.sha(",".join(written)), i
        assert set(written) <= set(filter(None, got[i]["spans"].split(","))) and got[i]["n_hex"] == sum(n == "hex" for *_, n in spans)
    assert got[1010]["max_uses"] == 12 and got[1001]["max_owners"] == got[1001]["max_repositories"] == got[1001]["max_uses"] == 1 and got[1003]["max_uses"] == 0
    assert got[1001]["spans"] == f"owned:2:{2 + len(key)}" and got[1001]["n_owned"] == 1
    assert all(got[1010 + i]["n_owned"] == 0 and got[1010 + i]["n_copied"] == 1 for i in range(12))
    hidden = secrets.redact_secrets(brute.frame(spark, every))
    assert hidden.columns == brute.frame(spark, every).columns
    texts = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert texts[1001] == "é [REDACTED] here" and texts[1003] is None and key not in str(texts)
    assert texts[1000].count("[REDACTED]") == 3


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"{i:016x}" for i in range(1000))
    got = secrets.secret_report(brute.frame(spark, [(1, text)])).first()
    assert got["base_sha256"] == brute.sha(",".join(f"{n}:{a}:{b}" for a, b, n in brute.secrets(text))) and got["n_hex"] == 1000


def test_quality_rules_query(docs, rows):
    got = collected(quality_rules.quality_rules(docs))
    for i, t in rows:
        assert got[i] == brute.quality_rules(i, t), i


def test_quality_rules_count_characters_of_repeated_lines(spark):
    """Few lines repeat, and none has words enough for a coverage, but most characters lie in them."""
    short = [f"short line {i}" for i in range(40)]
    rows = [(1, "\n".join(short)), (2, "\n".join(short[:20] + ["長" * 900] * 3 + short[20:])), (3, "\n".join(short + short[:2])), (4, "\n".join(short + ["長" * 900]))]
    got = collected(quality_rules.quality_rules(brute.frame(spark, rows)))
    assert {i: (r["kept"], r["base_failed"], r["dup_line_chars"]) for i, r in got.items()} == {1: (True, False, 0), 2: (False, False, 1800), 3: (True, False, 24), 4: (True, False, 0)}


def test_fingerprints_query(docs, rows):
    got = collected(fingerprints.compare_with_edits(docs))
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), brute.sha(edited)), i
        if len(t) < 20_000:
            assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (brute.written(t), brute.written(edited)), i
            assert got[i]["near_edited"] == brute.alike(t, edited)
            if len(after) < 20_000:
                assert got[i]["near_next"] == brute.alike(t, after)
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 400 and r["near_next"] < 0.1]
    assert long and all(r["near_edited"] > r["near_next"] for r in long)


def test_fingerprints_of_one_document_and_many_buckets(spark):
    one = fingerprints.compare_with_edits(brute.frame(spark, [(5, "abcdefghij" * 5)])).first()
    assert one["edited_sha256"] == brute.sha("abcdefghij" * 2 + "abcde" + "abcdefghij" * 2 + "abcde") and one["near_next"] == 1.0
    rows = [(i * 7 % 3001, f"text number {i} " * (i % 5 + 1)) for i in range(3001)]
    got = collected(fingerprints.compare_with_edits(brute.frame(spark, rows)))
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        assert got[i]["edited_sha256"] == brute.sha(t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2])


def test_likeness_follows_places():
    """Moved passages agree in part, an added word leaves less than all, equal texts agree wholly; written fingerprints say the same."""
    import random

    rng = random.Random(6)
    a, b = (brute.passage(rng, 150) for _ in range(2))
    texts = [a + " " + b, b + " " + a, a + " " + b + " end", a + " " + b, "", brute.passage(rng, 300)]
    table = fingerprints.sketch(texts)
    whole, back = table.take(np.zeros(len(texts), int)), fingerprints.parse(table.strings())
    near = fingerprints.likeness(whole, table)
    assert near[0] == near[3] == 1 and 0.9 < near[2] < 1 and 0.3 < near[1] < 0.7 and near[4] == 0 and near[5] < 0.1
    assert [brute.alike(texts[0], t) for t in texts] == near.tolist() == fingerprints.likeness(back.take(np.zeros(len(texts), int)), back).tolist()
    assert fingerprints.likeness(fingerprints.sketch([""]), fingerprints.sketch([""]))[0] == 1


def test_syncmers_are_context_free():
    inner = "the quick brown fox jumps over the lazy dog and runs away from all of it"
    text, at, h = fingerprints.anchors([inner, "Some other lead: " + inner + " and a tail"])
    a, b = set(h[text == 0].tolist()), set(h[text == 1].tolist())
    assert a and a <= b
    place = {x: y for x, y in zip(h[text == 0].tolist(), at[text == 0].tolist())}
    assert {y - place[x] for x, y in zip(h[text == 1].tolist(), at[text == 1].tolist()) if x in place} == {len("Some other lead: ")}


def test_warc_query(spark):
    pages = [(5, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (9, None, None), (4, "http://c", ""), (7, "http://d\r\nX: y", "é" * 5000), (8, "http://e", "a\r\n\r\nb"), (8, "http://e", "a\r\n\r\nb"), (None, "http://n", "<p>x</p>"), (None, "http://m", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [r.asDict() for r in warc.archive_round_trip(df.crossJoin(spark.range(1).selectExpr("'x' AS head", "'y' AS sha256"))).collect()]
    bodies = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, b in bodies:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    expected = []
    for i, b in bodies:
        revisit = first.get(b, i) != i
        expected.append({"page_id": i, "payload_bytes": len(b), "payload_digest": base64.b32encode(hashlib.sha1(b).digest()).decode(), "record_type": "revisit" if revisit else "response", "refers_to": first[b] if revisit else None})
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(expected)
    records = warc.read_archive(*warc.write_archive(df)).collect()
    assert {warc.parse_record(r["record"])[0]["WARC-Target-URI"] for r in records} >= {"http://d%0D%0AX: y", ""}
    records = warc.read_archive(*warc.write_archive(df, min_bytes=100)).collect()
    assert {warc.parse_record(r["record"])[0]["WARC-Type"] for r in records} == {"response"}
    with pytest.raises(ValueError):
        warc.parse_record(records[0]["record"][:-1])


def test_warc_files(spark, tmp_path):
    """Files of gzip members that any reader takes: every record whole, long payloads, revisits and an empty archive too."""
    import gzip

    pages = [(i, f"http://{i}", "x" * 3_000_000 if i == 3 else f"<p>{i % 4}</p>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    records = warc.read_archive(*warc.write_archive(df))
    index = warc.write_files(records, f"file://{tmp_path}/w")
    expected = {r.page_id: bytes(r.record) for r in records.collect()}
    assert {r.page_id: bytes(r.record) for r in warc.read_files(spark, f"file://{tmp_path}/w", index).collect()} == expected
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
    assert len(whole) == sum(map(len, expected.values())) and whole.count(b"WARC/1.1\r\n") == 20 and all(x in whole for x in expected.values())
    assert warc.write_files(records.where("page_id < 0"), f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("run", [
    lambda d: bpe.bpe_digests(d, BYTE), lambda d: packing.pack_documents(d, WORD), substring.repeat_digests, substring.remove_repeats, jaccard.jaccard_components, jaccard.keep_one_of_each,
    secrets.secret_report, secrets.redact_secrets, quality_rules.quality_rules, fingerprints.compare_with_edits, fingerprints.document_anchors, lambda d: warc.archive_round_trip(d.selectExpr("doc_id AS page_id", "lang AS url", "text AS html")),
])
def test_empty_table(spark, run):
    assert run(brute.frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


def test_jaccard_of_random_small_tables(spark):
    """Families of texts of 1 to 14 words of a few patterns, so that sizes, places and pivots meet in every way."""
    rng, rows = np.random.default_rng(11), []
    for family in range(40):
        base = [[f"w{x}" for x in rng.integers(0, 2**40, 14)] for _ in range(2)]
        for i in range(24):
            w = list(base[rng.integers(2)])
            a, b = sorted(rng.integers(0, 15, 2))
            w = w[a:b] if rng.random() < 0.5 else w[: max(1, 14 - rng.integers(0, 9))]
            if w and rng.random() < 0.3:
                w[rng.integers(len(w))] = f"x{family}_{rng.integers(0, 3)}"
            rows.append((len(rows), " ".join(w)))
    got = collected(jaccard.jaccard_components(brute.frame(spark, rows, extra=False)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute.components(rows)


def test_one_of_each_with_odd_rows(spark):
    """Null and repeated ids, repeated rows, texts without words, names with dots."""
    text, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (4, text + " x"), (9, text), (None, other), (None, other), (5, None), (5, None), (6, " \n"), (None, "")]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, `a.b c` string").withColumnRenamed("a.b c", "node.x`y")
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r[0], r[1]) for r in kept.collect()), key=str)
    words = [r for r in got if r[1] and r[1].strip()]
    assert len(words) == 2 and (None, other) in words and [r for r in words if r[0] == 4][0][1] in (text, text + " x")
    assert sorted((r for r in got if r not in words), key=str) == sorted([(5, None), (5, None), (6, " \n"), (None, "")], key=str)


@pytest.mark.parametrize("window", [1, 3, 20])
def test_subtree_of_suffixes(window):
    """Order, common prefixes and deep nodes against sorted lists of words."""
    rng = np.random.default_rng(window)
    words, seg = rng.integers(1, 4, 400).astype(np.uint64), 4
    starts = np.concatenate([np.arange(i * 100, i * 100 + 100 - window) for i in range(seg)])
    key, code = starts // 100, starts % 100
    tree = substring.build_subtree(words, starts, key, code, window)
    plain = sorted((tuple(words[s : s + window].tolist()), k, c) for s, k, c in zip(starts.tolist(), key.tolist(), code.tolist()))
    assert [(tuple(words[starts[i] : starts[i] + window].tolist()), key[i], code[i]) for i in tree.order] == plain
    common = [0] + [next((n for n in range(window) if a[0][n] != b[0][n]), window) for a, b in zip(plain, plain[1:])]
    assert tree.common.tolist() == common
    groups = {}
    for i, (x, _, _) in enumerate(plain):
        groups.setdefault(x, []).append(i)
    assert list(zip(*(x.tolist() for x in tree.nodes(window)))) == [(v[0], len(v)) for v in groups.values() if len(v) > 1]


def test_parts_that_outgrow_memory_are_split(docs, rows):
    """Parts of a few hundred words: prefixes are lengthened up to whole windows, with the same result."""
    runs = substring.later_windows(docs, most=300)
    got = {r["key"]: bytes(r["runs"]) for r in runs.collect()}
    expected = {r["key"]: bytes(r["runs"]) for r in substring.later_windows(docs).collect()}
    assert got == expected and len(got) > 10


def test_groups_of_longer_prefixes():
    """Equal windows are in one group at every level; the last level has a group for each window."""
    rng = np.random.default_rng(4)
    words = np.tile(rng.integers(1, 2**40, 60).astype(np.uint64), 3)
    words[130] = 7
    starts, place, _ = substring.smallest_runs(words, np.zeros(len(words), np.int64), 20)
    windows = [tuple(words[s : s + 20].tolist()) for s in starts]
    counts = []
    for level in range(6):
        group = substring.groups_of(words, starts, place, level, 20)
        assert all(len({group[i] for i in range(len(starts)) if windows[i] == w}) == 1 for w in windows[:50])
        counts.append(len(set(group.tolist())))
    assert counts == sorted(counts) and counts[0] < counts[-1] == len(set(windows))


def test_secrets_copied_over_repositories(spark):
    """One owner's value counts as copied where four of its repositories have it, however often three use it."""
    few, many = "abc_live_key_0123456789", "abc_copied_key_987654321"
    rows = [(i, f"{few} {i}", "one", "abc"[i % 3]) for i in range(9)] + [(100 + i, f"{many} {i}", "one", "abcd"[i % 4]) for i in range(4)]
    got = collected(secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")))
    assert all((got[i]["n_owned"], got[i]["max_repositories"], got[i]["max_uses"]) == (1, 3, 9) for i in range(9))
    assert all((got[100 + i]["n_owned"], got[100 + i]["n_copied"], got[100 + i]["max_owners"]) == (0, 1, 1) for i in range(4))
    alone = collected(secrets.secret_report(spark.createDataFrame([(1, few), (None, None)], "doc_id long, text string")))
    assert alone[1]["n_owned"] == 1 and alone[None]["spans"] == ""


def test_rows_without_ids_are_apart(spark):
    """Many null ids: no group of their own, the same results as with ids below all others; no join of all with all."""
    rng = __import__("random").Random(3)
    base = brute.passage(rng, 60)
    rows = [(None, brute.passage(rng, 40)) for _ in range(300)] + [(None, base + f" t{i}") for i in range(30)] + [(None, base)] * 3 + [(5, base), (6, "alone")]
    docs = brute.frame(spark, rows, extra=False)
    got = jaccard.jaccard_components(docs).collect()
    assert sum(r.component_id == 5 for r in got) == 34 and sum(r.component_id is None for r in got) == 300 and len(got) == len(rows)
    assert len(jaccard.keep_one_of_each(docs).where("doc_id = 5 or doc_id is null").collect()) == 301
    cut = substring.repeat_digests(docs).collect()
    assert sum(r.doc_id is None for r in cut) == 333 and sum(r.n_removed > 0 for r in cut) >= 31 and {r.doc_id: r.n_removed for r in cut if r.doc_id}[5] == 60
    near = fingerprints.compare_with_edits(docs).collect()
    assert len(near) == len(rows) and {r.doc_id: r.edited_sha256 for r in near}[6] == brute.sha("alo" + base[:2])


def test_rolling_hashes_tell_runs_apart_wherever_they_lie():
    """Equal for equal runs and for no others, in one sequence and in another one with other values before them."""
    from vellum.llm.quality_rules import Rolling

    draw = np.random.default_rng(5)
    words = draw.integers(1, 2**63, 3).astype(np.uint64)
    for size in (0, 1, 2, 19, 20, 400):
        x, y = draw.integers(0, 3, size), draw.integers(0, 3, 7)
        sequences = [x, np.concatenate([y, x])]
        for n in (3, 5, 10, 20):
            found: dict[tuple, int] = {}
            for s in sequences:
                hashes = Rolling(words[s]).hashes(n).tolist()
                assert len(hashes) == max(0, len(s) - n + 1)
                for i, h in enumerate(hashes):
                    assert found.setdefault(tuple(s[i : i + n].tolist()), h) == h
            assert len(set(found.values())) == len(found)
