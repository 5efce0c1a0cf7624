"""Quality classifier by co-training of two views.

One view sees the text's content, free of its size; the other the page's metadata (stated length, source, language).
Each is a logistic model over binned figures. In each round either view labels the unlabelled documents it is surest of
for the other. All unlabelled documents of the table take part: they stay on the executors, which count how sure a view
is of them and add up the Newton sums of those that are labelled; the driver sees sums of fixed size. Both views are then
calibrated on labelled documents that neither trained on, and a logistic model over the two calibrated views scores
every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.common import U64, Words, bound_batches, grams, lean, materialize, mix, scratch, slices, text_bytes, unburden

#: Labelled documents of each label that fit the models, at most. Rounds; pseudo-labels of a view in a round, as a share
#: of the unlabelled; least probability of one; weight of all of them to that of the labelled, at equal numbers.
PER_LABEL, ROUNDS, SHARE, SURE, PSEUDO = 3000, 4, 0.05, 0.9, 0.5
BINS, SOURCES, RIDGE, STEPS = 10, 64, 1.0, 4
HELD_OUT_OF, CALIBRATE_OF = 5, 4
#: Counters of how sure a view is, over margins up to the largest; tasks whose sums the driver takes; unlabelled documents of a partition.
LEVELS, LARGEST, FAN_IN, POOL_ROWS = 512, 30.0, 16, 50_000
#: Bytes of text that the figures are taken of at once.
PASS_BYTES = 2 << 20

CONTENT = ("distinct", "repeat_2", "repeat_5", "common_word", "doubled", "dup_lines", "symbols", "bars", "digits", "capitals", "marks", "word_size", "long_words", "short_words", "shouts")
META = ("log_chars", "source", "lang")
#: Columns of META that are bucket numbers already.
BUCKETS = {1: SOURCES, 2: SOURCES}
SCHEMA = "doc_id long, held_out boolean, score double, kept boolean, content_score double, metadata_score double"

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, list(b"#*$%&<>@^~_\\{}[]=+")] = True
_CLASS[1, list(b"|")] = True
_CLASS[2, 48:58] = True
_CLASS[3, 65:91] = True
_CLASS[4, list(b".,;:!?'\"()-")] = True
_CLASS[5, list(b"!")] = True


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _share_repeated(h: np.ndarray, doc: np.ndarray, n: int, texts: int) -> np.ndarray:
    """Share of a text's runs of n words that equal another run of it."""
    g = grams(h, n)
    if not len(g):
        return np.zeros(texts)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(g)])
    _, where, count = np.unique(mix(g[at] ^ mix(doc[at].astype(U64))), return_inverse=True, return_counts=True)
    every = np.bincount(doc[at], minlength=texts)
    return np.bincount(doc[at], weights=count[where] > 1, minlength=texts) / np.maximum(1, every)


def content_figures(col: pa.Array) -> np.ndarray:
    """One row of CONTENT figures for each text."""
    w, texts = Words(col, fold=True), len(col)
    h, n = w.hashes(), w.count.astype(np.float64)
    m, size = np.maximum(1, n), w.ends - w.starts
    _, first, where, count = np.unique(mix(h ^ mix(w.doc.astype(U64))), return_index=True, return_inverse=True, return_counts=True)
    common = np.zeros(texts)
    np.maximum.at(common, w.doc[first], count)
    doubled = np.zeros(len(h), bool)
    doubled[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    lines = np.zeros(texts)
    for i, b in enumerate(text_bytes(col)):
        own = [x for x in b.split(b"\n") if x.strip()]
        lines[i] = 1 - len(set(own)) / len(own) if own else 0
    kinds = [_sums(c[w.data], w.offsets) for c in _CLASS]
    chars = np.maximum(1, _sums(w.solid, w.offsets))
    per_word = lambda x: np.bincount(w.doc, weights=x, minlength=texts) / m
    out = [
        np.bincount(w.doc[first], minlength=texts) / m ** 0.9, _share_repeated(h, w.doc, 2, texts), _share_repeated(h, w.doc, 5, texts), common / m, per_word(doubled), lines,
        kinds[0] / m, kinds[1] / m, kinds[2] / chars, kinds[3] / chars, kinds[4] / m, per_word(size), per_word(size > 14), per_word(size < 4), kinds[5] / m,
    ]
    return np.stack(out, axis=1)


def meta_figures(batch: pa.RecordBatch) -> np.ndarray:
    """One row of META figures: the stated length as a number, source and language as bucket numbers."""
    n = batch.num_rows
    if "chars" not in batch.schema.names:
        return np.zeros((n, len(META)))
    chars, source, lang = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("chars", "source_bucket", "lang_bucket"))
    return np.stack([np.log1p(np.maximum(chars, 0)), source, lang], axis=1)


@dataclass
class View:
    """A logistic model over one-hot bins of figures; ``buckets``: columns that are bucket numbers already."""

    buckets: dict[int, int] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    offset: float = 0.0

    def set_bins(self, quantiles: list[np.ndarray]) -> None:
        """Bins between the given quantiles of each figure."""
        self.edges = [np.arange(1, self.buckets[j]) - 0.5 if j in self.buckets else np.unique(q) for j, q in enumerate(quantiles)]
        self.weights = np.zeros(1 + sum(len(e) + 1 for e in self.edges))

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for j, e in enumerate(self.edges):
            parts.append(np.eye(len(e) + 1)[np.searchsorted(e, x[:, j], side="left")])
        return np.concatenate(parts, axis=1)

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the weighted log loss."""
        d = self.design(x)
        p = 1 / (1 + np.exp(-np.clip(d @ self.weights, -30, 30)))
        return d.T @ (w * (p - y)), (d * (w * p * (1 - p))[:, None]).T @ d

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        m = self.margin(x)
        self.offset, self.slope = logistic(np.stack([np.ones(len(m)), m], axis=1), y, w, 1e-3)
        self.slope = max(0.0, self.slope)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (w * (p - y)) + ridge * beta)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return beta


@dataclass
class Model:
    content: View
    meta: View
    blend: np.ndarray

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.probability(content), self.meta.probability(meta)
        x = np.stack([np.ones(len(a)), _logit(a), _logit(b)], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.blend, -30, 30))), a, b


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def sure_counts(views: list[View], xs: list[np.ndarray], given: np.ndarray) -> np.ndarray:
    """Counts by view, label and level of the margin, of the documents that a view is sure of and the other has no label for."""
    out = np.zeros((2, 2, LEVELS), np.int64)
    for v in (0, 1):
        free = given[:, 1 - v] < 0
        m = views[v].margin(xs[v][free])
        for y, q in ((0, -m), (1, m)):
            level = level_of(q)
            out[v, y] = np.bincount(level[level >= 0], minlength=LEVELS)
    return out


def level_of(margin: np.ndarray) -> np.ndarray:
    """The level of a margin; negative below the least that counts as sure."""
    least = np.log(SURE / (1 - SURE))
    return np.minimum(np.floor((margin - least) / (LARGEST - least) * LEVELS).astype(np.int64), LEVELS - 1)


def give(views: list[View], xs: list[np.ndarray], given: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The labels after a round: each view labels, for the other, what it is sure of from the least level on. Earlier labels stay."""
    out = given.copy()
    for v in (0, 1):
        m = views[v].margin(xs[v])
        for y, q in ((0, -m), (1, m)):
            out[(given[:, 1 - v] < 0) & (level_of(q) >= least[v, y]), 1 - v] = y
    return out


def pool_sums(views: list[View], xs: list[np.ndarray], given: np.ndarray) -> np.ndarray:
    """Gradients and Hessians of both views over the documents that have a label for them, in one row."""
    out = []
    for v in (0, 1):
        own = given[:, v] >= 0
        out += [a.reshape(-1) for a in views[v].sums(xs[v][own], given[own, v].astype(float), np.ones(int(own.sum())))]
    return np.concatenate(out)


class LocalPool:
    """Unlabelled documents in memory."""

    def __init__(self, content: np.ndarray, meta: np.ndarray):
        self.xs, self.given, self.n = [content, meta], np.full((len(content), 2), -1, np.int8), len(content)

    def counts(self, views: list[View]) -> np.ndarray:
        return sure_counts(views, self.xs, self.given)

    def give(self, views: list[View], least: np.ndarray) -> None:
        self.given = give(views, self.xs, self.given, least)

    def sums(self, views: list[View]) -> np.ndarray:
        return pool_sums(views, self.xs, self.given)


def _unpacked(b: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(CONTENT) + len(META))
    given = np.stack([b.column(f"given_{v}").to_numpy(zero_copy_only=False) for v in (0, 1)], axis=1) if "given_0" in b.schema.names else np.full((b.num_rows, 2), -1, np.int8)
    return [x[:, : len(CONTENT)], x[:, len(CONTENT) :]], given


class SparkPool:
    """Unlabelled documents on the executors: a table of figures and of the labels that each view was given."""

    def __init__(self, figures: DataFrame):
        """``figures``: x of every unlabelled document."""
        self.n = figures.count()
        self.parts = 1 + self.n // POOL_ROWS
        self.table = materialize(figures.select("x", *(F.lit(-1).cast("byte").alias(f"given_{v}") for v in (0, 1))).coalesce(self.parts), "pool")

    def _total(self, rows: DataFrame, sums: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray | int:
        """The sum over all documents of what ``sums`` gives for some: added in each task, then by ``FAN_IN`` tasks, then here."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, task = None, TaskContext.get().partitionId()
            for b in batches:
                own = sums(*_unpacked(b))
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([task % FAN_IN], pa.int32()), pa.array([task], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str])], names=["slot", "task", "total", "kind"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots: dict[int, tuple[np.ndarray, str]] = {}
            for b in batches:
                for r in sorted(b.to_pylist(), key=lambda r: r["task"]):
                    own = np.frombuffer(r["total"], r["kind"])
                    slots[r["slot"]] = (own + slots[r["slot"]][0] if r["slot"] in slots else own, r["kind"])
            for slot, (total, kind) in slots.items():
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([kind])], names=["slot", "task", "total", "kind"])

        schema = "slot int, task int, total binary, kind string"
        out = rows.mapInArrow(lean(add), schema)
        if self.parts > FAN_IN:
            out = out.repartition(FAN_IN, "slot").sortWithinPartitions("slot", "task").mapInArrow(lean(merge), schema)
        return sum(np.frombuffer(r["total"], r["kind"]) for r in sorted(out.collect(), key=lambda r: (r["slot"], r["task"])))

    def counts(self, views: list[View]) -> np.ndarray:
        return np.reshape(self._total(self.table, lambda xs, given: sure_counts(views, xs, given).reshape(-1)), (2, 2, LEVELS))

    def give(self, views: list[View], least: np.ndarray) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                after = give(views, *_unpacked(b), least).astype(np.int8)
                yield pa.RecordBatch.from_arrays([b.column("x"), pa.array(after[:, 0]), pa.array(after[:, 1])], names=["x", "given_0", "given_1"])

        self.table = materialize(self.table.mapInArrow(lean(run), "x array<float>, given_0 byte, given_1 byte"), "pool")

    def sums(self, views: list[View]) -> np.ndarray | int:
        return self._total(self.table.where("given_0 >= 0 or given_1 >= 0"), lambda xs, given: pool_sums(views, xs, given))


def least_levels(counts: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """For each view and label the lowest level from which on no more than the quota is left, the highest one that any document has at most."""
    out = np.full((2, 2), LEVELS, np.int64)
    for v in (0, 1):
        for y in (0, 1):
            some = np.flatnonzero(counts[v, y])
            if len(some):
                above = np.cumsum(counts[v, y][::-1])[::-1]
                out[v, y] = min(int(np.argmax(above <= quota[y])) if (above <= quota[y]).any() else LEVELS, int(some[-1]))
    return out


def co_train(content: np.ndarray, meta: np.ndarray, label: np.ndarray, role: np.ndarray, weight: np.ndarray, pool: LocalPool | SparkPool, quantiles: list[list[np.ndarray]]) -> Model:
    """Fit both views on labelled documents and the pool. ``role``: true where a document is for calibration only."""
    views, xs = [View(), View(buckets=BUCKETS)], [content, meta]
    for v in (0, 1):
        views[v].set_bins(quantiles[v])
    train, y = ~role, label.astype(float)
    base_rate = np.average(y[train], weights=weight[train])
    quota = SHARE * pool.n * np.array([1 - base_rate, base_rate])
    each = PSEUDO * weight[train].sum() / max(1, pool.n)  # so that the pool weighs alike at every size
    for r in range(ROUNDS + 1):
        if r:
            pool.give(views, least_levels(pool.counts(views), quota))
        for _ in range(STEPS if r else 30):
            extra, at, steps = pool.sums(views) if r else 0, 0, []
            for v in (0, 1):
                g, h = views[v].sums(xs[v][train], y[train], weight[train])
                if np.ndim(extra):
                    g, at = g + each * extra[at : at + g.size], at + g.size
                    h, at = h + each * extra[at : at + h.size].reshape(h.shape), at + h.size
                steps.append(np.clip(np.linalg.solve(h + RIDGE * np.eye(len(g)), g + RIDGE * views[v].weights), -3, 3))
                views[v].weights = views[v].weights - steps[-1]
            if max(np.abs(x).max() for x in steps) < 1e-7:
                break
        if not pool.n:
            break
    check = role if len(np.unique(label[role])) > 1 else train
    for v in (0, 1):
        views[v].calibrate(xs[v][check], y[check], weight[check])
    a, b = (_logit(views[v].probability(xs[v][check])) for v in (0, 1))
    return Model(*views, logistic(np.stack([np.ones(len(a)), a, b], axis=1), y[check], weight[check], 1e-2))


def _inputs(docs: DataFrame) -> dict[str, Column]:
    """What the figures are taken of: the text and the page's metadata, nulls and missing columns included."""
    own = lambda c, instead: F.coalesce(F.col(c), instead) if c in docs.columns else instead
    bucket = lambda c: F.pmod(F.crc32(own(c, F.lit("")).cast("string")), F.lit(SOURCES)).cast("int")
    return {"text": F.coalesce(F.col("text").cast("string"), F.lit("")), "chars": own("n_chars", F.lit(0)).try_cast("double"), "source_bucket": bucket("source"), "lang_bucket": bucket("lang")}


def figures_of(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the figures of every document, 18 numbers. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, max_bytes=PASS_BYTES):
                x = np.concatenate([content_figures(b.column("text")), meta_figures(b)], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))], names=["doc_id", "x"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in _inputs(docs).items())).mapInArrow(lean(run), "doc_id long, x array<float>")


def remainder() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0).cast("long"))


def fit(figures: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Co-train on at most ``per_label`` labelled documents of each quality and all unlabelled ones.

    ``figures``: the table of ``figures_of``. Bins, quotas and pseudo-labels come from all of it. Labelled documents
    whose crc32(doc_id) mod 5 is 0 are held out; null labels and ids do not count; of repeated rows of a labelled
    document one counts. None if a label has no document."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").dropDuplicates(["doc_id"])
    usable = known.join(figures.select("doc_id"), "doc_id", "left_semi").where(remainder() % HELD_OUT_OF != 0)
    prior = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    if len(prior) < 2:
        return None
    sample = [usable.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    bounded = figures.sparkSession.createDataFrame([tuple(r) for r in sample[0].unionByName(sample[1]).collect()], "doc_id long, quality int")
    rows = figures.join(F.broadcast(bounded), "doc_id").dropDuplicates(["doc_id"]).toArrow().to_pandas().sort_values("doc_id")
    x, label, ids = np.stack(rows["x"].to_list()).astype(np.float64), rows["quality"].to_numpy(np.int64), rows["doc_id"].to_numpy(np.int64)
    role = mix(ids.view(U64)) % U64(CALIBRATE_OF) == 0
    if len(np.unique(label[~role])) < 2:
        role[:] = False
    weight = np.where(label == 1, prior[1] / max(1, (label == 1).sum()), prior[0] / max(1, (label == 0).sum()))
    n, cuts = len(CONTENT), [i / BINS for i in range(1, BINS)]
    numeric = [j for j in range(n + len(META)) if j - n not in BUCKETS]
    found = figures.agg(*(F.percentile_approx(F.col("x")[j], cuts, 2000).alias(f"q{j}") for j in numeric)).first()
    edges = [np.array(found[f"q{j}"]) if j in numeric else np.zeros(0) for j in range(n + len(META))]
    with scratch(figures.sparkSession):
        pool = SparkPool(figures.where("doc_id is not null").join(known.select("doc_id"), "doc_id", "left_anti"))
        return co_train(x[:, :n], x[:, n:], label, role, weight / weight.mean(), pool, [edges[:n], edges[n:]])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text from 0 to 1 (higher: good quality is likelier) and keep those of at least 0.5.

    Null and empty texts are scored by their figures like others, very long ones are taken whole; a null source or
    language is a value of its own; a null doc_id counts as held out; repeated rows get equal results; without labels of
    both kinds every document scores 1 and is kept; an empty table gives an empty result; columns other than text,
    n_chars, source and lang are ignored."""
    figures = materialize(figures_of(docs), "figures")
    shared = docs.sparkSession.sparkContext.broadcast(fit(figures, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ones = np.ones(b.num_rows)
            score, content, meta = model.scores(*_unpacked(b)[0]) if model else (ones, ones, ones)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *map(pa.array, (score, score >= 0.5, content, meta))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return figures.select("doc_id", (remainder() % HELD_OUT_OF == 0).alias("held_out"), "x").mapInArrow(lean(run), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their columns, whatever their names.

    Two passes over the texts, one to fit and one to judge; texts are neither written nor shuffled. Null, empty and very
    long texts, null ids, repeated rows, missing labels and empty tables: see ``score_quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(materialize(figures_of(docs), "figures"), labels))

    @F.arrow_udf("boolean")
    def good(text: pa.Array, chars: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
        unburden()
        model = shared.value
        if model is None:
            return pa.array(np.ones(len(text), bool))
        batch = pa.RecordBatch.from_arrays([text, chars, source, lang], names=["text", "chars", "source_bucket", "lang_bucket"])
        rows = [np.concatenate([content_figures(b.column("text")), meta_figures(b)], axis=1).astype(np.float32).astype(np.float64) for b in slices(batch, max_bytes=PASS_BYTES)]
        return pa.array(np.concatenate([model.scores(x[:, : len(CONTENT)], x[:, len(CONTENT) :])[0] >= 0.5 for x in rows] or [np.zeros(0, bool)]))

    bound_batches(docs.sparkSession)
    return docs.where(good(*_inputs(docs).values()))
