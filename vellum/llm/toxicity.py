"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features are words and starts of words that are more frequent in toxic examples than in clean ones, by a lower bound of
the log odds ratio, and in any case the ``LEAST_FEATURES`` best. Examples that are alike stand in one block. A feature has
postings: the blocks that have it, with its largest weight in each. A text reads the postings of its own features alone,
which bounds its cosine with all examples of a block; blocks are visited by falling bound, and none whose bound is below
the cosines already found. Texts that visit a block meet its examples together, as one product. The votes of the nearest,
weighted by cosine, give the score; a text without a feature has no neighbour and no vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import U64, _FOLDED, _powers, Words, lean, materialize, mix, scratch, slices, texts

#: Examples of each label, taken by a hash of doc_id, that fit the index.
EXAMPLES_PER_LABEL = 4000
#: Toxic examples that have a feature at least; standard errors between its log odds ratio and the lower bound, which must
#: not be negative; features that count in any case, so that a small table has some.
LEAST_EXAMPLES, ERRORS, LEAST_FEATURES = 2, 3.0, 300
#: Lengths of word starts in bytes; neighbours that vote; examples of a block; weight of the vote for no label.
STARTS, NEIGHBOURS, BLOCK, DOUBT = (4, 5, 6, 8), 15, 64, 0.3
#: Counts in one text from which a feature has a further feature of its own: a word said often is not one said once.
LEVELS = (2, 3, 5)
HELD_OUT_OF = 5
#: Texts that meet the blocks together, and postings that are read at once, unless one text has more; bound of the relative
#: error of a sum of up to 16,000 products in single precision.
GROUP, READ, ROUNDING = 256, 1 << 20, 1e-3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, nearest long, nearest_cosine double, evidence array<long>"

_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"')")] = True


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every occurrence: each word without its closing marks, and its starts of given lengths."""
    w = Words(col, fold=True)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    body = w.data[w.solid]
    size = w.ends - w.starts
    begin = np.cumsum(size) - size
    inside = np.arange(len(body)) - np.repeat(begin, size)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_FOLDED[body] * _powers(int(size.max()))[inside], dtype=U64)])
    bare = size.copy()
    for _ in range(3):
        bare -= (bare > 1) & _TRIM[body[begin + bare - 1]]
    text, found = [w.doc], [mix(total[begin + bare] - total[begin])]
    for n in STARTS:
        long = bare >= n
        text.append(w.doc[long])
        found.append(mix((total[begin[long] + n] - total[begin[long]]) ^ U64(n)))
    return np.concatenate(text), np.concatenate(found)


def counted(text: np.ndarray, feature: np.ndarray, watch: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, base, tf) of occurrences, each once for a text, with the further features of larger counts.

    ``watch``: the sorted features that matter; others are left out first."""
    if watch is not None:
        at = np.minimum(np.searchsorted(watch, feature), len(watch) - 1)
        hit = watch[at] == feature
        key, tf = np.unique(text[hit] * len(watch) + at[hit], return_counts=True)
        text, feature = key // len(watch), watch[key % len(watch)]
    else:
        order = np.lexsort((feature, text))
        text, feature = text[order], feature[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(text)))
        text, feature = text[first], feature[first]
    more = [(text[tf >= n], mix(feature[tf >= n] ^ (U64(n) << U64(32))), feature[tf >= n], np.ones(int((tf >= n).sum()), np.int64)) for n in LEVELS]
    return tuple(np.concatenate(x) for x in zip((text, feature, feature, tf), *more, strict=True))


@dataclass
class Index:
    """Examples in blocks of like ones: the features and weights of each example."""

    hashes: np.ndarray  # sorted features
    watch: np.ndarray  # sorted features that these derive from
    weight: np.ndarray  # inverse document frequencies
    examples: np.ndarray  # doc_id of each example, in index order
    labels: np.ndarray
    start: np.ndarray  # of the features of each example
    at: np.ndarray
    value: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("blocks", "postings")}  # each worker makes its own

    @cached_property
    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block its features and its weights, example by feature."""
        out = []
        for b in range(-(-len(self.examples) // BLOCK)):
            rows = self.start[b * BLOCK : (b + 1) * BLOCK + 1]
            own, column = np.unique(self.at[rows[0] : rows[-1]], return_inverse=True)
            body = np.zeros((len(rows) - 1, len(own)), np.float32)
            body[np.repeat(np.arange(len(rows) - 1), np.diff(rows)), column] = self.value[rows[0] : rows[-1]]
            out.append((own, body))
        return out

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each feature the blocks that have it and its largest weight in each, feature by feature; where those of a feature begin."""
        feature, block = np.concatenate([own for own, _ in self.blocks]), np.repeat(np.arange(len(self.blocks)), [len(own) for own, _ in self.blocks])
        largest = np.concatenate([body.max(axis=0, initial=0) for _, body in self.blocks])
        order = np.lexsort((block, feature))
        return block[order], largest[order].astype(np.float64), np.searchsorted(feature[order], np.arange(len(self.hashes) + 1))

    def vectors(self, text: np.ndarray, feature: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors as (text, feature number, weight), sorted by text, from distinct (text, feature) and counts."""
        at = np.minimum(np.searchsorted(self.hashes, feature), len(self.hashes) - 1)
        known = np.flatnonzero(self.hashes[at] == feature)
        known = known[np.lexsort((at[known], text[known]))]
        text, at = text[known], at[known]
        value = (1 + np.log(tf[known])) * self.weight[at]
        norm = np.sqrt(np.bincount(text, weights=value * value)) if len(text) else np.zeros(0)
        return text, at, value / norm[text]

    def queries(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, feature, _, tf = counted(*features(col), self.watch)
        return self.vectors(text, feature, tf)

    def nearest(self, at: np.ndarray, value: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The search for one text."""
        return self.search(np.array([0, len(at)]), at, value, k, np.array([without]))[0]

    def search(self, cut: np.ndarray, at: np.ndarray, value: np.ndarray, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the k examples of the largest cosine (ties: the smaller place), exactly; examples that share no feature do not count.

        Text i has the features ``at[cut[i]:cut[i + 1]]`` and does not meet the example ``without[i]``, if that is one."""
        found = [(np.zeros(0, np.int64), np.zeros(0))] * (len(cut) - 1)
        texts = np.flatnonzero(np.diff(cut))
        if len(texts) > GROUP:  # texts that prefer a block meet it together
            first = [self._bounds(texts[i : i + GROUP], cut, at, value).argmax(axis=1) for i in range(0, len(texts), GROUP)]
            texts = texts[np.argsort(np.concatenate(first), kind="stable")]
        query = np.zeros(len(self.hashes))
        for i in range(0, len(texts), GROUP):
            group = texts[i : i + GROUP]
            for t, place in zip(group.tolist(), self._candidates(group, cut, at, value, k, without), strict=True):
                own = slice(cut[t], cut[t + 1])
                query[at[own]] = value[own]
                size = self.start[place + 1] - self.start[place]
                inner = np.arange(int(size.sum())) + np.repeat(self.start[place] - np.cumsum(size) + size, size)
                cosine = np.bincount(np.repeat(np.arange(len(place)), size), weights=self.value[inner] * query[self.at[inner]], minlength=len(place))
                query[at[own]] = 0
                by = np.lexsort((place, -cosine))[:k]
                found[t] = place[by], cosine[by]
        return found

    def _bounds(self, texts: np.ndarray, cut: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Text by block: what the postings of the text's own features allow its cosine with an example of the block to be."""
        block, largest, pairs = self.postings
        out, i = np.zeros((len(texts), len(self.blocks))), 0
        reads = np.array([np.diff(pairs)[at[cut[t] : cut[t + 1]]].sum() for t in texts.tolist()])
        while i < len(texts):
            to = max(i + 1, i + int(np.searchsorted(np.cumsum(reads[i:]), READ, side="right")))
            own, size = _runs(cut[texts[i:to]], cut[texts[i:to] + 1] - cut[texts[i:to]]), cut[texts[i:to] + 1] - cut[texts[i:to]]
            many = pairs[at[own] + 1] - pairs[at[own]]
            pair, row = _runs(pairs[at[own]], many), np.repeat(np.repeat(np.arange(to - i), size), many)
            out[i:to] = np.bincount(row * len(self.blocks) + block[pair], np.repeat(value[own], many) * largest[pair], minlength=(to - i) * len(self.blocks)).reshape(to - i, -1)
            i = to
        return out

    def _columns(self, texts: np.ndarray, cut: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Feature by text."""
        size = cut[texts + 1] - cut[texts]
        inner = np.arange(int(size.sum())) + np.repeat(cut[texts] - np.cumsum(size) + size, size)
        out = np.zeros((len(self.hashes), len(texts)), np.float32)
        out[at[inner], np.repeat(np.arange(len(texts)), size)] = value[inner]
        return out

    def _candidates(self, texts: np.ndarray, cut: np.ndarray, at: np.ndarray, value: np.ndarray, k: int, without: np.ndarray | None) -> Iterator[np.ndarray]:
        """Of each text the places of all examples that may be among its k nearest, whatever single precision rounds."""
        blocks, x = self.blocks, self._columns(texts, cut, at, value)
        bound = self._bounds(texts, cut, at, value)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        score, least, done = np.zeros((len(texts), len(self.examples)), np.float32), np.zeros(len(texts), np.float32), np.zeros(bound.shape, bool)
        for step in (2, 8, len(blocks)):
            need = (bound > 0) & ~done & (rank < step) & (bound >= least[:, None] * (1 - 2 * ROUNDING))
            for b in np.flatnonzero(need.any(axis=0)).tolist():
                own, body = blocks[b]
                some = np.flatnonzero(need[:, b])
                some = slice(None) if 2 * len(some) > len(texts) else some
                score[some, b * BLOCK : b * BLOCK + len(body)] = (body @ x[own][:, some]).T
                done[some, b] = True
            if without is not None:
                out = np.flatnonzero(without[texts] >= 0)
                score[out, without[texts[out]]] = 0
            if k <= score.shape[1]:
                least = np.partition(score, -k, axis=1)[:, -k]
        for row, low in zip(score, least, strict=True):
            yield np.flatnonzero((row > 0) & (row >= low * (1 - 2 * ROUNDING)))

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine * self.labels[place]).sum() / (cosine.sum() + DOUBT))

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of runs that begin at ``start``, one run after another."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def alike(t: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, features: int) -> np.ndarray:
    """An order of n examples in which those of a block are alike: cut in two across the direction of the widest spread,
    and each part again, down to one block."""
    rng, group = np.random.default_rng(0), np.zeros(n, np.int64)
    while n and (size := np.bincount(group)).max() > BLOCK:
        spread, cell = rng.normal(size=n), group[t] * features + at
        for _ in range(4):
            spread -= (np.bincount(group, spread) / size)[group]
            spread /= np.sqrt(np.bincount(group, spread * spread) + 1e-30)[group]
            axis = np.bincount(cell, value * spread[t], minlength=len(size) * features)
            spread = np.bincount(t, value * axis[cell], minlength=n)
        by, place = np.lexsort((spread, group)), np.empty(n, np.int64)
        place[by] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        group = np.unique(2 * group + (place >= (-(-size // (2 * BLOCK)) * BLOCK)[group]), return_inverse=True)[1]
    return np.argsort(group, kind="stable")


def build_index(hashes: np.ndarray, watch: np.ndarray, weight: np.ndarray, doc_ids: np.ndarray, labels: np.ndarray, vectors: tuple) -> Index:
    """The index of examples given by (text, feature, count)."""
    index = Index(hashes, watch, weight, doc_ids, labels.astype(np.float64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
    t, at, value = index.vectors(*vectors)
    order = alike(t, at, value, len(doc_ids), len(hashes))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    index.examples, index.labels = doc_ids[order], index.labels[order]
    by = np.argsort(place[t], kind="stable")
    index.start = np.concatenate([[0], np.cumsum(np.bincount(place[t], minlength=len(order)))]).astype(np.int64)
    index.at, index.value = at[by].astype(np.int32), value[by]
    return index


def _remainder() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0).cast("long")) % HELD_OUT_OF


def fit(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES_PER_LABEL) -> Index | None:
    """The index; see ``_fit``. The tables that it is made of go when it is there."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels, per_label)


def _fit(docs: DataFrame, labels: DataFrame, per_label: int) -> Index | None:
    """Fit the index on a bounded sample of labelled documents whose crc32(doc_id) mod 5 is not 0.

    The sample, at most ``per_label`` documents of each label, is all that grows not with the input; document
    frequencies are counted over all documents. None if a label has no example."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (_remainder() != 0)).dropDuplicates(["doc_id"])
    prior = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(prior) < 2:
        return None
    sample = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    sample = sample[0].unionByName(sample[1])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                text, feature, base, tf = counted(*features(b.column("text")))
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("toxic").take(row), pa.array(feature.view(np.int64)), pa.array(base.view(np.int64)), pa.array(tf)], names=["doc_id", "toxic", "feature", "base", "tf"])

    examples = texts(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    found = materialize(examples.select("doc_id", "text", "toxic").mapInArrow(lean(occurrences), "doc_id long, toxic int, feature long, base long, tf long"), "examples")
    have = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if len(have) < 2:
        return None
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n1, n0 = float(have[1]), float(have[0])
    cells = [c + 0.5 for c in (a, n1 - a, b, n0 - b)]
    lower = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3]) - ERRORS * F.sqrt(sum((1 / c for c in cells), F.lit(0.0)))
    rated = found.groupBy("feature", "base").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.sum(1 - F.col("toxic").cast("long")).alias("b")).where(F.col("a") >= LEAST_EXAMPLES).withColumn("lower", lower)
    picked = rated.where("lower >= 0").select("feature", "base").collect()
    if len(picked) < LEAST_FEATURES:
        picked = rated.orderBy(F.desc("lower"), "feature").limit(LEAST_FEATURES).select("feature", "base").collect()
    if not picked:
        return None
    hashes = np.unique(np.array([r["feature"] for r in picked], np.int64).view(U64))
    watch = np.unique(np.array([r["base"] for r in picked], np.int64).view(U64))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(hashes), np.int64), 0
        for whole in batches:
            for b in slices(whole):
                _, feature, _, _ = counted(*features(b.column("text")), watch)
                at = np.minimum(np.searchsorted(hashes, feature), len(hashes) - 1)
                df += np.bincount(at[hashes[at] == feature], minlength=len(hashes))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*np.flatnonzero(df), -1], pa.int32()), pa.array([*df[df > 0], n], pa.int64())], names=["at", "df"])

    df_of = {r["at"]: r["df"] for r in texts(docs).select("text").mapInArrow(lean(frequencies), "at int, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()}
    weight = np.log((1 + df_of.get(-1, 0)) / (1 + np.array([df_of.get(i, 0) for i in range(len(hashes))]))) + 1.0
    rows = found.join(F.broadcast(spark.createDataFrame([(r["feature"],) for r in picked], "feature long").distinct()), "feature").select("doc_id", "feature", "tf").toArrow()
    names = found.groupBy("doc_id").agg(F.first("toxic").alias("toxic")).toArrow().sort_by("doc_id")
    doc_ids, y = names["doc_id"].to_numpy(), names["toxic"].to_numpy().astype(np.int64)
    vectors = (np.searchsorted(doc_ids, rows["doc_id"].to_numpy()), rows["feature"].to_numpy().view(U64), rows["tf"].to_numpy())
    index = build_index(hashes, watch, weight, doc_ids, y, vectors)
    calibrate(index, vectors, doc_ids, {c: prior[c] / have[c] for c in (0, 1)})
    return index


def calibrate(index: Index, vectors: tuple, doc_ids: np.ndarray, share: dict[int, float]) -> None:
    """Logistic calibration of the leave-one-out votes, each label weighted to its share of all labelled documents."""
    place = {d: i for i, d in enumerate(index.examples.tolist())}
    own = np.array([place[d] for d in doc_ids.tolist()], np.int64)
    y = index.labels[own]
    t, at, value = index.vectors(*vectors)
    cut = np.searchsorted(t, np.arange(len(doc_ids) + 1))
    votes = np.array([index.vote(*x) for x in index.search(cut, at, value, NEIGHBOURS, own)])
    w = np.where(y == 1, share[1], share[0])
    a, b = 4.0, -2.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * votes + b, -30, 30)))
        g = np.array([(w * (p - y) * votes).sum() + 1e-3 * a, (w * (p - y)).sum()])
        h = w * p * (1 - p)
        m = np.array([[(h * votes * votes).sum() + 1e-3, (h * votes).sum()], [(h * votes).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(m, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    index.slope, index.offset = float(a), float(b)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES_PER_LABEL) -> DataFrame:
    """Score every whole text from 0 to 1; higher: the label 1 is likelier. ``evidence``: the nearest examples' doc_ids.

    Texts without a known feature, empty and null ones too, get the calibrated score of no vote. Labels whose doc_id or
    value is null are left out; a null doc_id counts as held out; repeated rows get equal results; without examples of
    both labels every score is 0; an empty table gives an empty result; other columns are ignored. The index holds
    ``per_label`` examples a label with all their features that pass the test, and goes to the tasks as a broadcast."""
    index = fit(docs, labels, per_label)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for b in slices(whole):
                n = b.num_rows
                score = np.zeros(n) if index is None else np.full(n, index.score(0.0))
                near, cosine, evidence = [None] * n, np.zeros(n), [[] for _ in range(n)]
                if index is not None:
                    text, at, value = index.queries(b.column("text"))
                    cut = np.searchsorted(text, np.arange(n + 1))
                    for i, (place, c) in enumerate(index.search(cut, at, value, NEIGHBOURS)):
                        if len(place):
                            score[i], cosine[i] = index.score(index.vote(place, c)), min(1.0, c[0])
                            evidence[i] = index.examples[place[:3]].tolist()
                            near[i] = evidence[i][0]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(near, pa.int64()), pa.array(cosine), pa.array(evidence, pa.list_(pa.int64()))],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return texts(docs).withColumn("held_out", _remainder() == 0).mapInArrow(lean(run), SCHEMA)
