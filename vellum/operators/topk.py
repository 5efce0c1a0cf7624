"""The best passages of a corpus for each question, found without making every pair of a question and a passage; and all
pairs that have something in common, made where a passage lies, without a shuffle.

Each task keeps for each question the k best passages it has seen. A question's least kept score tells how many of its
terms a passage must share to get in at all, whatever the bonuses: only passages with one of the question's rarest
terms, as many as leave fewer common ones than that, are looked at, so that common terms are dropped as scores rise.
Passages that have only hint categories in common with a question score alike by their set of categories: the first k of
each set stand for all. What tasks hand on is k rows a question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vellum.functions import lexicons as lex

#: Pairs of a question and a passage that are scored at once.
PAIRS = 1 << 18
#: Terms in common that a task's first stretch of passages has, about; each further one may have twice as many, up to ``PAIRS``.
FIRST = 1 << 11
#: Sums are kept for all pairs of a stretch if these are at most so many times the terms in common.
DENSE = 8
#: Scores are rounded to three digits: what may be lost by that, with room.
SLACK = 0.001


class Questions:
    """The questions' terms as numbers, and the words of the hint categories, for one task."""

    def __init__(self, ids: list, terms: list[list[str]], hints: dict[str, list[str]], frequent: int):
        self.ids = ids
        self.vocabulary = sorted({t for q in terms for t in q} | {w for words in hints.values() for w in words})
        place = {t: i for i, t in enumerate(self.vocabulary)}
        self.lo = np.concatenate([[0], np.cumsum([len(q) for q in terms])])
        self.terms = np.array([place[t] for q in terms for t in q], np.int64)
        self.size = np.diff(self.lo)
        self.category = np.zeros(len(self.vocabulary), np.int64)
        for bit, words in enumerate(hints.values()):
            self.category[[place[w] for w in words]] |= 1 << bit
        self.asked = np.zeros(len(terms), np.int64)
        np.bitwise_or.at(self.asked, np.repeat(np.arange(len(terms)), self.size), self.category[self.terms])
        self.frequent = frequent

    def bits(self, mask: np.ndarray) -> np.ndarray:
        return np.bitwise_count(mask).astype(np.int64)

    def score(self, shared: np.ndarray, size: np.ndarray, hints: np.ndarray, often: np.ndarray) -> np.ndarray:
        value = np.minimum(shared / size + hints * lex.HINT_BONUS + often * lex.FREQUENCY_BONUS, 1.0)
        scaled = value * 1000
        out = np.rint(scaled) / 1000
        for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
            out[i] = float(f"{value[i]:.3f}")  # half-even of the exact binary value
        return out


def each_of(values: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value): the values of each row's stretch, of which ``start`` and ``size`` tell the place by the row's number in ``of``."""
    n = size[of]
    row = np.repeat(np.arange(len(of)), n)
    return row, values[np.arange(len(row)) + np.repeat(start[of] - (np.cumsum(n) - n), n)]


class Best:
    """The k best passages of each question so far."""

    def __init__(self, questions: Questions, k: int):
        self.q, self.k = questions, k
        n = len(questions.size)
        self.rows: list[list[tuple]] = [[] for _ in range(n)]  # (-score, source, place, shared), a source after those without an id
        self.least = np.full(n, -1.0)  # the k-th best score, once there are k
        self.seen = np.zeros(len(questions.vocabulary), np.int64)  # passages with each term
        self.plain: dict[int, list[tuple]] = {}  # by the set of categories, the first k passages
        self.room = min(FIRST, PAIRS)  # terms in common of the next stretch

    def offer(self, q: int, row: tuple) -> None:
        kept = self.rows[q]
        if len(kept) == self.k and row[:3] >= kept[-1][:3]:
            return
        kept.append(row)
        kept.sort(key=lambda r: r[:3])
        del kept[self.k :]
        if len(kept) == self.k:
            self.least[q] = -kept[-1][0]

    def needed(self) -> np.ndarray:
        """How many terms a passage must share with each question to get in."""
        hints = self.q.bits(self.q.asked) * lex.HINT_BONUS
        each = 1 / np.maximum(self.q.size, 1) + lex.FREQUENCY_CAP
        return np.where(self.least < 0, 1, np.maximum(1, np.ceil((self.least - SLACK - hints) / each))).astype(np.int64)

    def rare_first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, question, whether essential), the terms of a question by how many passages have them."""
        question = np.repeat(np.arange(len(self.q.size)), self.q.size)
        order = np.lexsort((self.seen[self.q.terms], question))
        rank = np.arange(len(order)) - np.repeat(self.q.lo[:-1], self.q.size)
        return self.q.terms[order], question, rank < np.repeat(self.q.size - self.needed() + 1, self.q.size)

    def essential(self) -> tuple[np.ndarray, np.ndarray]:
        """(term, question) of the terms that a passage must have one of: a question's rarest, all but one fewer than needed."""
        term, question, on = self.rare_first()
        return term[on], question[on]

    def take(self, sources: list, places: np.ndarray, term: np.ndarray, passage: np.ndarray) -> None:
        """Passages by number with their tokens that questions or categories know."""
        many, vocabulary = len(sources), len(self.q.vocabulary)
        key, tf = np.unique(passage * vocabulary + term, return_counts=True)
        p, t = key // vocabulary, key % vocabulary
        tf = np.minimum(tf, self.q.frequent)
        self.seen += np.bincount(t, minlength=vocabulary)
        mask = np.zeros(many, np.int64)
        np.bitwise_or.at(mask, p, self.q.category[t])
        for m in np.unique(mask[mask > 0]).tolist():
            first = self.plain.setdefault(m, [])
            first.extend((sources[i], int(places[i])) for i in np.flatnonzero(mask == m).tolist())
            first.sort()
            del first[self.k :]
        found, done = (key, tf, mask, np.bincount(p, tf - 1, minlength=many)), 0
        while done < len(t):  # a stretch of the passages' terms at a time, short ones first, so that scores rise early
            if not done or self.room < PAIRS:
                term, question, on = self.rare_first()
                order = np.argsort(term[on], kind="stable")
                by, start = question[on][order], np.searchsorted(term[on][order], np.arange(vocabulary + 1))
                asking, other = np.diff(start), (term[~on], np.bincount(question[~on], minlength=len(self.q.size)))
            ends = np.cumsum(asking[t[done:]])
            upto = done + max(1, int(np.searchsorted(ends, min(self.room, PAIRS), side="right")))
            while upto < len(t) and p[upto] == p[upto - 1]:
                upto += 1
            n = asking[t[done:upto]]
            at = np.arange(int(n.sum())) + np.repeat(start[t[done:upto]] - (np.cumsum(n) - n), n)
            self._score(*self._promising(p[done:upto], tf[done:upto], n, by[at], other, found), found, sources, places)
            self.room, done = min(2 * self.room, PAIRS), upto

    def _promising(self, p: np.ndarray, tf: np.ndarray, n: np.ndarray, by: np.ndarray, other: tuple, found: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(passage, question) of the pairs that can get in. What their essential terms give is added up, ``n`` questions
        asking for each; the ``other`` terms are looked for only where they and the categories of both can give what lacks."""
        mask, repeats = found[2:]
        terms, rest = other
        many = len(self.q.size)
        each, least = 1 / np.maximum(self.q.size, 1), self.least - SLACK
        lowest = least - rest * (each + lex.FREQUENCY_CAP) - self.q.bits(self.q.asked) * lex.HINT_BONUS
        lowest = np.maximum(lowest, SLACK * each)  # above nothing, below one term
        cell, gain = np.repeat((p - p[0]) * many, n) + by, each[by] + np.repeat(tf * lex.FREQUENCY_BONUS, n)
        if int(p[-1] - p[0] + 1) * many <= DENSE * len(cell):
            total = np.bincount(cell, gain, minlength=int(p[-1] - p[0] + 1) * many)
            cell = np.flatnonzero(total.reshape(-1, many) >= lowest)
            total = total[cell]
        else:
            cell, row = np.unique(cell, return_inverse=True)
            total = np.bincount(row, gain, minlength=len(cell))
        i, j = cell // many + p[0], cell % many
        total = total + self.q.bits(mask[i] & self.q.asked[j]) * lex.HINT_BONUS
        often = np.minimum(rest[j] * (self.q.frequent - 1), repeats[i])
        on = total + rest[j] * (each[j] + lex.FREQUENCY_BONUS) + often * lex.FREQUENCY_BONUS >= least[j]
        i, j, total = i[on], j[on], total[on]
        row, term = each_of(terms, np.cumsum(rest) - rest, rest, j)
        often = self._often(i[row], term, found)
        total = total + np.bincount(row, (often > 0) * each[j][row] + often * lex.FREQUENCY_BONUS, minlength=len(i))
        on = total >= least[j]
        return i[on], j[on]

    def _often(self, p: np.ndarray, term: np.ndarray, found: tuple) -> np.ndarray:
        """How often passages have terms, as it counts."""
        key, tf = found[:2]
        wanted = p * len(self.q.vocabulary) + term
        at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        return np.where(key[at] == wanted, tf[at], 0) if len(key) else np.zeros(len(wanted), np.int64)

    def _score(self, p: np.ndarray, q: np.ndarray, found: tuple, sources: list, places: np.ndarray) -> None:
        size = self.q.size[q]
        row, term = each_of(self.q.terms, self.q.lo[:-1], self.q.size, q)
        tf = self._often(p[row], term, found)
        shared = np.bincount(row[tf > 0], minlength=len(p))
        often = np.bincount(row, tf, minlength=len(p)).astype(np.int64)
        hints = self.q.bits(found[2][p] & self.q.asked[q])
        value = shared / size + hints * lex.HINT_BONUS + often * lex.FREQUENCY_BONUS
        fits = np.flatnonzero(value >= self.least[q] - SLACK)
        score = self.q.score(shared[fits], size[fits], hints[fits], often[fits])
        order = np.lexsort((p[fits], -score, q[fits]))
        for i in order.tolist():
            j = fits[i]
            if score[i] >= self.least[q[j]]:
                self.offer(int(q[j]), (-float(score[i]), sources[p[j]], int(places[p[j]]), int(shared[j])))

    def finish(self) -> Iterator[tuple]:
        """(question, source, place, score, shared) of the best, those that share only categories included."""
        for m, first in self.plain.items():
            common = self.q.bits(np.int64(m) & self.q.asked)
            for q in np.flatnonzero(common > 0).tolist():
                score = float(self.q.score(np.zeros(1), np.ones(1), common[q : q + 1], np.zeros(1))[0])
                held = {r[1:3] for r in self.rows[q]}
                for s, place in first:
                    if (s, place) not in held:
                        self.offer(q, (-score, s, place, 0))
        for q, rows in enumerate(self.rows):
            for by, s, place, shared in rows:
                yield q, s, place, -by, shared


def known_tokens(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term, passage) of the known ones among the tokens of passages, which come as one text each, with spaces between."""
    tokens = pc.split_pattern(texts, " ")
    passage = np.repeat(np.arange(len(texts)), np.diff(tokens.offsets.to_numpy()))
    term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
    return term[term >= 0], passage[term >= 0]


def best_passages(shared, k: int) -> Callable:
    """(s_id, pos, tokens) to (q_id, s_id, pos, score, n_shared), k rows a question at most for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(shared.value, k), None
        known = pa.array(shared.value.vocabulary, pa.string())
        for batch in batches:
            kind = batch.column("s_id").type
            term, passage = known_tokens(batch.column("tokens"), known)
            best.take([(s is not None, s) for s in batch.column("s_id").to_pylist()], batch.column("pos").to_numpy(), term, passage)
        rows = list(best.finish())
        if rows:
            q, s, place, score, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.ids[i] for i in q]), pa.array([x[1] for x in s], kind), pa.array(place, pa.int64()), pa.array(score, pa.float64()), pa.array(n, pa.int32())], ["q_id", "s_id", "pos", "score", "n_shared"])

    return run


def met_passages(shared, kind: pa.DataType) -> Callable:
    """(s_id, pos, tokens) to (q_id, s_id, pos, terms, score, n, shared), a row for each question that a passage has a term or
    a hint category in common with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Questions = shared.value
        known, ids, size = pa.array(q.vocabulary, pa.string()), pa.array(q.ids, kind), np.diff(q.lo)
        by_term = np.argsort(q.terms, kind="stable")
        owner = np.repeat(np.arange(len(size)), size)[by_term]
        ends = np.searchsorted(q.terms[by_term], np.arange(len(q.vocabulary) + 1))
        hinted = [int(m) for m in np.unique(q.asked[q.asked > 0])]
        for batch in batches:
            if not len(known):
                continue
            term, passage = known_tokens(batch.column("tokens"), known)
            key, tf = np.unique(passage * len(known) + term, return_counts=True)
            p, t = key // len(known), key % len(known)
            mask = np.zeros(batch.num_rows, np.int64)
            np.bitwise_or.at(mask, p, q.category[t])
            many = np.bincount(p, ends[t + 1] - ends[t], minlength=batch.num_rows) + (len(size) if hinted else 0)
            lo = 0
            while lo < batch.num_rows:  # passages of a bounded number of pairs at a time
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(many[lo:]), PAIRS, side="right")) + lo)
                a, b = np.searchsorted(p, [lo, hi])
                n = ends[t[a:b] + 1] - ends[t[a:b]]
                at = np.repeat(ends[t[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                pair = np.repeat(p[a:b], n) * len(size) + owner[at]
                order = np.argsort(pair, kind="stable")  # terms stay in their order
                pair, said, often = pair[order], np.repeat(t[a:b], n)[order], np.repeat(np.minimum(tf[a:b], q.frequent), n)[order]
                alike = [np.flatnonzero(mask[lo:hi] & m)[:, None] + lo for m in hinted]
                marked = [(x * len(size) + np.flatnonzero(q.asked == m)[None, :]).ravel() for x, m in zip(alike, hinted, strict=True)]
                every = np.unique(np.concatenate([pair, *marked])).astype(np.int64)
                if len(every):
                    row = np.searchsorted(every, pair)
                    count = np.bincount(row, minlength=len(every))
                    i, j = every // len(size), every % len(size)
                    score = q.score(count, np.maximum(size[j], 1), q.bits(mask[i] & q.asked[j]), np.bincount(row, often, minlength=len(every)))
                    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), known.take(pa.array(said)))
                    columns = [ids.take(pa.array(j)), batch.column("s_id").take(pa.array(i)), batch.column("pos").take(pa.array(i)), pa.array(size[j], pa.int32()), pa.array(score, pa.float64()), pa.array(count, pa.int64()), words]
                    yield pa.RecordBatch.from_arrays(columns, ["q_id", "s_id", "pos", "terms", "score", "n", "shared"])
                lo = hi

    return run
