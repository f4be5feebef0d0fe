"""Quality rules over labelled lines.

Lines of a document form a sequence; a two-state linear-chain conditional random field reads simple measures of each line
(symbols, case, repetition, length) and Viterbi decoding marks it content or boilerplate. The share of words in content
lines decides whether the document stays, after basic rules on its number of words and its repetition.

The field is fitted on a bounded sample of documents with quality labels. Labels are for documents, so line labels start
from them (all lines of a bad document are boilerplate) and are then decoded anew, a few rounds: lines that look like those
of good documents become content, the worst line of a bad document stays boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chain import Chain, Layout
from .labelled import labelled_sample
from .shared import with_text, unused
from .textkit import Hasher, Runs, mix, slices, windows

#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LINE_BREAK = np.zeros(256, bool)
LINE_BREAK[10] = True
LEAST_WORDS, MOST_REPEATED, CONTENT_SHARE = 50, 50, 0.5
MOST = (1500, 3000)
ROUNDS, STEPS, RATE = 3, 60, 0.3


@dataclass
class Measures:
    """Of each text: the contract's counts; of each of its lines that has a word: features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: np.ndarray  # lines with a word, of each text
    features: np.ndarray
    line_words: np.ndarray


def repeats(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more in their row, and which occurred earlier in it."""
    both = mix(keys + mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    laid = both[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = laid[1:] == laid[:-1]
    twice, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def measure(buf: np.ndarray, offs: np.ndarray) -> Measures:
    n = len(offs) - 1
    runs = Runs(buf, offs)
    hasher = Hasher(buf)
    words = hasher.strong(runs.start, runs.end)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    heads, symbols = count((buf & 0xC0) != 0x80), count(SYMBOLS[buf])
    upper, bang, digit = count((buf >= 65) & (buf <= 90)), count(buf == 33), count((buf >= 48) & (buf <= 57))
    letters = count(((buf | 32) >= 97) & ((buf | 32) <= 122))
    total = lambda values: np.bincount(runs.row, values, n).astype(np.int64)
    chars = heads[runs.end] - heads[runs.start]

    triple, first = windows(words, runs.row, 3)
    twice, _ = repeats(triple, runs.row[first])
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, first[twice], 1)
    np.add.at(marks, first[twice] + 3, -1)
    repeated = np.cumsum(marks)[:-1] > 0

    # lines that have a word: every word belongs to one, found by the line feeds before it
    breaks = count(LINE_BREAK[buf])
    line_of_word = breaks[runs.start] + runs.row  # ascending: a new row or a line feed adds one
    opens = np.flatnonzero(np.diff(line_of_word, prepend=-1))
    line_row = runs.row[opens]
    feeds = np.flatnonzero(LINE_BREAK[buf])
    after = np.searchsorted(feeds, runs.start[opens])
    begin = np.maximum(offs[line_row], np.where(after > 0, feeds[after - 1] + 1, 0) if len(feeds) else 0)
    end = np.minimum(offs[line_row + 1], np.where(after < len(feeds), feeds[np.minimum(after, len(feeds) - 1)], len(buf)) if len(feeds) else len(buf))
    line_key = hasher.strong(begin, end)
    _, seen = repeats(line_key, line_row)

    per_line = lambda values: np.add.reduceat(values, opens) if len(opens) else np.zeros(0)
    line_words = np.diff(np.append(opens, len(words))).astype(float)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (np.diff(runs.row) == 0)
    span = lambda sums: (sums[end] - sums[begin]).astype(float)
    size = np.maximum(span(heads), 1)
    features = np.stack(
        [
            np.minimum(span(symbols) / line_words, 2),
            span(symbols) > 0.3 * line_words,
            np.minimum(span(bang) / line_words, 2),
            span(bang) > 0.3 * line_words,
            span(upper) / np.maximum(span(letters), 1),
            span(upper) > 0.5 * np.maximum(span(letters), 4),
            span(digit) / size,
            per_line(same) / line_words,
            per_line(same) > 0.3 * line_words,
            per_line(repeated.astype(float)) / line_words,
            seen,
            np.log1p(line_words) / 4,
            line_words <= 3,
            size / line_words > 15,
            np.ones(len(opens)),
        ],
        1,
    ).astype(float)
    return Measures(
        total(np.ones(len(words))), total(chars), symbols[offs[1:]] - symbols[offs[:-1]], np.bincount(line_row, seen, n).astype(np.int64),
        total(repeated), np.bincount(line_row, minlength=n), features, line_words,
    )


N_FEATURES = 15


@dataclass
class Model:
    weights: np.ndarray
    chain: Chain

    def content(self, m: Measures) -> tuple[np.ndarray, np.ndarray]:
        """Share of words in content lines of each text, and the state of each line (True: content)."""
        at = Layout(m.lines)
        state = self.chain.viterbi(at, m.features @ self.weights)
        n = len(m.lines)
        return np.bincount(at.row, m.line_words * state, n) / np.maximum(np.bincount(at.row, m.line_words, n), 1), state


def fit(parts: list[Measures], label: np.ndarray) -> Model:
    """label: 1 for good documents. With only one class, every line counts as content."""
    bias = np.zeros(N_FEATURES)
    bias[-1] = 3.0
    model = Model(bias, Chain(0.0, np.zeros((2, 2))))
    good = np.asarray(label, int) == 1
    if not parts or good.all() or not good.any():
        return model
    x, lengths = np.concatenate([p.features for p in parts]), np.concatenate([p.lines for p in parts])
    at = Layout(lengths)
    fixed = good[at.row]
    weight = np.where(fixed, 1.0, fixed.sum() / max(1, (~fixed).sum()))
    y = fixed.astype(float)
    for turn in range(ROUNDS):
        w, chain = model.weights.copy(), model.chain
        step, rest = np.full(N_FEATURES, 1e-3), np.full(5, 1e-3)
        for _ in range(STEPS):
            gap, moves, start = chain.expectations(at, x @ w, y)
            g = x.T @ (gap * weight) / len(y) + 1e-3 * w
            step += g * g
            w -= RATE * g / np.sqrt(step)
            g = np.concatenate([[start], moves.ravel()]) / len(y) + 1e-2 * np.concatenate([[chain.start], chain.trans.ravel()])
            rest += g * g
            move = RATE * g / np.sqrt(rest)
            chain = Chain(chain.start - float(move[0]), chain.trans - move[1:].reshape(2, 2))
        model = Model(w, chain)
        if turn + 1 < ROUNDS:
            e = x @ w
            y = np.where(fixed, 1.0, chain.viterbi(at, e))
            starts = np.cumsum(lengths) - lengths
            for d in np.flatnonzero(~good & (lengths > 0)):
                lo, hi = starts[d], starts[d] + lengths[d]
                if y[lo:hi].all():
                    y[lo + int(np.argmin(e[lo:hi]))] = 0.0
    return model


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, most: tuple[int, int] = MOST) -> Model:
    """Fits on at most ``most`` labelled documents of each class (bad, good).

    Null labels and ids are left out, null and empty texts have no lines to learn from, and of repeated rows each counts. Where
    a class has no document, or there are none, the model calls every line content.
    """
    sample, _ = labelled_sample(docs, labels, "quality", most, held_out)
    t = sample.toArrow().sort_by("doc_id").combine_chunks()
    texts = t.column("text")
    parts = [measure(buf, offs) for chunk in texts.chunks for _, _, buf, offs in slices(chunk)]
    return fit(parts, np.array(t.column("label").to_pylist(), int))


def line_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), with_lines: bool = False) -> DataFrame:
    """``keep`` columns, the counts, base_failed, kept and content_share of every whole text; on request the line states.

    Words are runs without white space; a line has a word or isn't looked at. Null text has no words, so it fails the basic
    rules; repeated rows get equal results; an empty table gives no rows. Names that ``keep`` has get an underscore.
    """
    from pyspark.sql import types as T

    kept = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(unused(schema.names, c), "long")
    for c, kind in (("base_failed", "boolean"), ("kept", "boolean"), ("content_share", "double")):
        schema = schema.add(unused(schema.names, c), kind)
    if with_lines:
        schema = schema.add(unused(schema.names, "content_lines"), T.ArrayType(T.BooleanType()))

    rows, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in slices(b.column(at)):
                m = measure(buf, offs)
                share, state = kept.value.content(m)
                failed = (m.n_words < LEAST_WORDS) | (100 * m.n_repeat_words > MOST_REPEATED * m.n_words)
                columns = [c.slice(lo, hi - lo) for c in b.columns[: len(keep)]] + [pa.array(x) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, ~failed & (share >= CONTENT_SHARE), share)]
                if with_lines:
                    columns.append(pa.array([x.tolist() for x in np.split(state, np.cumsum(m.lines)[:-1])], pa.list_(pa.bool_())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
