"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.common import U64, Words, lean, mix, slices, text_bytes, texts

#: Rules of the base verdict.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_NGRAM = 50, 50, 3
#: (n, largest percentage of the characters in words that may lie in n-grams seen twice or more in the text).
COVERAGE_LIMITS = ((5, 35), (10, 30), (20, 25))
#: Largest percentage of lines with a word that repeat an earlier line, of the characters of lines that lie in such, of symbols to words.
MAX_DUP_LINES, MAX_DUP_LINE_CHARS, MAX_SYMBOLS = 50, 30, 25

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, dup_line_chars long, line_chars long, cover_5_chars long, cover_10_chars long, cover_20_chars long"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_doc(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: An odd number, so that it has an inverse: the base of the rolling hashes.
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 1 << 64)


class Rolling:
    """Rolling hashes of the runs of any length of one sequence of values, from prefix sums that are made once.

    The sum of value times BASE^-place up to each place; the difference of two such sums, times BASE^first, is the hash of
    the run between them and does not depend on where it lies. All numbers wrap at 64 bits."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix, self.up = np.zeros(n + 1, U64), np.full(n, BASE, U64)
        down = np.full(n, _INVERSE, U64)
        self.up[:1] = down[:1] = 1
        np.cumprod(self.up, out=self.up)
        np.cumsum(values * np.cumprod(down), out=self.prefix[1:])

    def hashes(self, n: int) -> np.ndarray:
        """One for each place where a run of ``n`` values begins, over the sequence as one (callers drop runs that cross texts)."""
        m = len(self.up) - n + 1
        return mix((self.prefix[n:] - self.prefix[:m]) * self.up[:m]) if m > 0 else np.zeros(0, U64)


def covered_words(g: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """True for each word that lies in a window of ``n`` words found twice or more in its own text; ``g``: the windows' hashes."""
    out = np.zeros(len(doc), bool)
    if not len(g):
        return out
    inside = doc[n - 1 :] == doc[: len(g)]
    key = mix(g ^ (doc[: len(g)].astype(U64) * U64(0xA0761D6478BD642F)))
    at = np.flatnonzero(inside)
    key = key[at]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    hits = at[order[twice]]
    steps = np.zeros(len(doc) + 1, np.int64)
    np.add.at(steps, hits, 1)
    np.add.at(steps, hits + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of figures and verdicts for each document of the batches."""
    for whole in batches:
        for batch in slices(whole):
            text = batch.column("text")
            w = Words(text)
            rolling = Rolling(w.hashes())
            lead = (w.data & 0xC0) != 0x80
            chars = _per_doc(lead & w.solid, w.offsets)
            symbols = _per_doc(_SYMBOL[w.data], w.offsets)
            total = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
            size = total[w.ends] - total[w.starts]
            repeat = _per_doc(covered_words(rolling.hashes(REPEAT_NGRAM), w.doc, REPEAT_NGRAM), w.first)
            cover = [_per_doc(np.where(covered_words(rolling.hashes(n), w.doc, n), size, 0), w.first) for n, _ in COVERAGE_LIMITS]
            lines, dup, dup_chars, line_chars = (np.zeros(len(text), np.int64) for _ in range(4))
            for i, b in enumerate(text_bytes(text)):
                own = [x for x in b.split(b"\n") if x.strip()]
                lines[i] = len(own)
                line_chars[i] = len(b"".join(own).decode("utf-8", "replace"))
                if len(distinct := set(own)) < len(own):
                    dup[i] = len(own) - len(distinct)
                    dup_chars[i] = line_chars[i] - len(b"".join(distinct).decode("utf-8", "replace"))
            n = w.count
            failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
            bad = failed | (100 * dup > MAX_DUP_LINES * lines) | (100 * dup_chars > MAX_DUP_LINE_CHARS * line_chars) | (100 * symbols > MAX_SYMBOLS * n)
            for c, (_, limit) in zip(cover, COVERAGE_LIMITS, strict=True):
                bad |= 100 * c > limit * chars
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, (n, chars, symbols, dup, repeat, failed, ~bad, lines, dup_chars, line_chars, *cover))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Repetition figures and a keep verdict for every document: one narrow Arrow pass, no shuffle.

    A document is kept unless the base rules fail it (under 50 words, or over half of its words in repeated
    3-word windows) or its repetition coverage does: the share of characters inside n-grams of 5, 10 or 20 words that
    occur again in the text is over its limit, or over half of its lines repeat an earlier one, or those hold over 30 %
    of the characters of its lines, or it has more than one symbol for four words.
    Null and empty texts have no words, so they fail. Repeated rows give repeated results; a null doc_id stays null;
    an empty table gives an empty result; other columns are ignored."""
    return texts(docs).mapInArrow(lean(measure), SCHEMA)
