"""Toxic spans by a linear-chain conditional random field over words.

Labels are for documents, so words are labelled first: in documents marked toxic, the words and word beginnings that
occur there in far more contexts than in unmarked ones (a likelihood-ratio test) are toxic, all else is
not. A two-state chain with hashed word and beginning features is fitted to these tokens. Every whole text is then tagged:
forward-backward marginals give offending offsets, and the sum of those over one half and the maximum the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chain import CHUNK, Chain, Layout, fit_logistic, layouts, sigmoid
from .labelled import labelled_sample
from .shared import crc_mod, unused, with_text
from .textkit import LOWER, PUNCT, Hasher, Runs, char_offsets, slices

HEAD_BYTES = 4
MOST = (2000, 1000)
LEAST_G2, LEAST_RATIO, ROUNDS, RATE = (22.0, 12.0), 8.0, 20, 0.5
NONE = np.zeros(0)
SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("score", "double"))


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[Runs, np.ndarray, np.ndarray]:
    """Words between white space and ASCII punctuation, with hashes of their features: lower-cased word, and beginning."""
    runs = Runs(buf, offs, PUNCT)
    hasher = Hasher(buf, LOWER)
    return runs, hasher.spans(runs.start, runs.end), hasher.spans(runs.start, np.minimum(runs.end, runs.start + HEAD_BYTES))


@dataclass
class Weights:
    """Sorted hashes of features and their weights; features that aren't there weigh nothing."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes), np.float32)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.values[at], np.float32(0))

    def strip(self, least: float = 0.2) -> Weights:
        kept = np.abs(self.values) >= least
        return Weights(self.keys[kept], self.values[kept])


@dataclass
class Model:
    word: Weights
    head: Weights
    bias: float
    chain: Chain
    document: np.ndarray  # weights of log1p(sum of marginals over 1/2), largest log odds / 10, 1

    def emissions(self, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        return self.word.of(word) + self.head.of(head) + np.float32(self.bias)

    def measures(self, lengths: np.ndarray, e: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each word, and of each document the sum of marginals over one half and the largest log odds."""
        odds = self.chain.marginals(at, e)
        total = np.bincount(at.row, sigmoid(odds) * (odds > 0), len(lengths))
        top = np.full(len(lengths), -30.0)
        some = np.flatnonzero(lengths)
        if len(some):
            top[some] = np.maximum.reduceat(odds, (np.cumsum(lengths) - lengths)[some])
        return odds, total, top

    def tag(self, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of documents, and their spans (start, end in code points; score): words likelier toxic than not."""
        scores, spans = [np.zeros(0)], []
        for _, _, buf, offs in slices(column):
            runs, word, head = tokens(buf, offs)
            lengths = np.diff(runs.bounds())
            odds, total, top = self.measures(lengths, self.emissions(word, head), Layout(lengths, CHUNK))
            scores.append(sigmoid(document_features(total, top) @ self.document))
            found: list[list[dict]] = [[] for _ in lengths]
            hot = np.flatnonzero(odds > 0)
            if len(hot):
                chars = char_offsets(buf)
                origin = chars[offs[runs.row[hot]]]
                for r, s, t, x in zip(runs.row[hot].tolist(), (chars[runs.start[hot]] - origin).tolist(), (chars[runs.end[hot]] - origin).tolist(), sigmoid(odds[hot]).tolist(), strict=True):
                    found[r].append({"start": s, "end": t, "score": round(x, 6)})
            spans += found
        return np.concatenate(scores), spans


def document_features(total: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), np.clip(top, -30, 30) / 10, np.ones(len(total))], 1)


def seeds(kind: np.ndarray, before: np.ndarray, doc: np.ndarray, toxic: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which feature numbers are out of proportion in toxic documents.

    In toxic ones counts are of documents or of distinct words ``before``, whichever are fewer, so that neither a text that
    occurs in many copies nor one that repeats itself counts more than once; elsewhere, whichever are more.
    """
    counts = []
    for some, choose in ((toxic, np.minimum), (~toxic, np.maximum)):
        counts.append(choose(*(distinct(kind[some], x[some], size) for x in (before, doc))))
    a, b = counts
    n, m = a.sum(), b.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        expect = (a + b) * n / (n + m)
        g2 = 2 * (np.nan_to_num(a * np.log(a / expect)) + np.nan_to_num(b * np.log(b / (a + b - expect))))
    return (g2 >= least) & ((a + 0.5) / (n + 1) >= LEAST_RATIO * (b + 0.5) / (m + 1))


def distinct(kind: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` kinds, how many different others come with it."""
    pairs = np.unique((other.astype(np.int64) << 32) | kind)
    return np.bincount(pairs & 0xFFFFFFFF, minlength=size).astype(float)


def many_words(head: np.ndarray, word: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Which beginnings belong to at least three words of toxic documents, and to relatively more there than elsewhere."""
    a, b = (distinct(head[some], word[some], size) for some in (toxic, ~toxic))
    return (a >= 3) & ((a + 0.5) / (a.sum() + 1) >= 3 * (b + 0.5) / (b.sum() + 1))


def fit(column: pa.Array, label: np.ndarray, there: tuple[int, int]) -> Model:
    """With no document of one of the classes, every score is the share of toxic ones."""
    toxic = np.asarray(label, int) == 1
    model = Model(Weights(NONE, NONE), Weights(NONE, NONE), -6.0, Chain(0.0, np.zeros((2, 2))), np.zeros(3))
    share = (there[1] + 1) / (sum(there) + 2)
    model.document[2] = np.log(share / (1 - share))
    if not toxic.any() or toxic.all():
        return model
    words, heads, lengths = [], [], []
    for _, _, buf, offs in slices(column):
        runs, word, head = tokens(buf, offs)
        words.append(word)
        heads.append(head)
        lengths.append(np.diff(runs.bounds()))
    del column
    lengths = np.concatenate(lengths)
    word_keys, word = _numbered(words)
    head_keys, head = _numbered(heads)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    marked, before = toxic[row], np.concatenate([word[:1] * 0, word[:-1]])
    bad_word = seeds(word, before, row, marked, len(word_keys), LEAST_G2[0])
    bad_head = many_words(head, word, marked, len(head_keys))
    bad_head &= seeds(head, before, row, marked, len(head_keys), LEAST_G2[1])
    y = (bad_word[word] | bad_head[head]) & marked
    del before, marked, row
    groups = list(layouts(lengths))
    weights = {"word": np.zeros(len(word_keys), np.float32), "head": np.zeros(len(head_keys), np.float32)}
    step = {"word": np.full(len(word_keys), 1e-6), "head": np.full(len(head_keys), 1e-6), "rest": np.full(6, 1e-6)}
    rate = RATE
    for _ in range(ROUNDS):  # adaptive gradient steps on the chain's log likelihood, with a small ridge
        slope = {"word": 0.01 * weights["word"], "head": 0.01 * weights["head"], "rest": np.zeros(6)}
        for part, at in groups:
            e = weights["word"][word[part]] + weights["head"][head[part]] + model.bias
            gap, moves, start = model.chain.expectations(at, e, y[part])
            for name, kind in (("word", word), ("head", head)):
                slope[name] = slope[name] + np.bincount(kind[part], gap, len(slope[name]))
            slope["rest"] += np.concatenate([[gap.sum(), start], moves.ravel()])
        slope["head"] *= bad_head  # a beginning counts only where many different words share it
        for name in ("word", "head"):
            g = slope[name]
            step[name] += g * g
            weights[name] -= (rate * 4 * g / np.sqrt(step[name])).astype(np.float32) * (np.abs(g) > 1e-9)
        g = slope["rest"]
        step["rest"] += g * g
        move = rate * g / np.sqrt(step["rest"])
        model.bias -= float(move[0])
        model.chain = Chain(model.chain.start - float(move[1]), model.chain.trans - move[2:].reshape(2, 2))
    model.word, model.head = Weights(word_keys, weights["word"]).strip(), Weights(head_keys, weights["head"]).strip()
    parts = [model.measures(at.lengths, model.emissions(word_keys[word[part]], head_keys[head[part]]), at)[1:] for part, at in groups]
    total, top = (np.concatenate(x) for x in zip(*parts, strict=True))
    weight = np.where(toxic, there[1] / toxic.sum(), there[0] / (~toxic).sum())
    model.document = fit_logistic(document_features(total, top), toxic.astype(float), weight / weight.mean(), ridge=1e-1)
    return model


def _numbered(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the number of each hash among them; empties the list."""
    keys = np.unique(np.concatenate([np.unique(h) for h in hashes]))
    out = np.concatenate([np.searchsorted(keys, h).astype(np.int32) for h in hashes])
    hashes.clear()
    return keys, out


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), most: tuple[int, int] = MOST) -> Model:
    """Fits on at most ``most`` labelled documents of each class (not toxic, toxic); the driver holds those only.

    Rows without doc_id, null labels and labels other than 0 and 1 are left out; null and empty texts have no words; of
    several labels for one id the largest counts, and each row that repeats an id is a document of the sample. With no rows
    of one class, or empty tables, the model gives one constant score.
    """
    sample, there = labelled_sample(docs, labels, "toxic", most, held_out)
    t = sample.toArrow().sort_by("doc_id").combine_chunks()
    text, label = t.column("text"), np.array(t.column("label").to_pylist(), int)
    del t
    return fit(text.chunk(0) if text.num_chunks == 1 else pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string()), label, there)


def tag(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, score, and spans array<struct<start, end, score>> of every whole text.

    Null and empty texts have no spans and the score of no words; repeated rows give equal results; an empty table no rows.
    Where ``keep`` has a column of that name, the new one is called score_ or spans_ (see ``unused``).
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema
    schema = schema.add(unused(keep, "score"), "double").add(unused(keep, "spans"), SPANS)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    rows, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, spans = kept.value.tag(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score, pa.float64()), pa.array(spans, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row; repeated rows get equal scores, an empty table no rows."""
    tagged = tag(docs, train(docs, labels, held_out))
    return tagged.select("doc_id", F.coalesce(crc_mod("doc_id", held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
