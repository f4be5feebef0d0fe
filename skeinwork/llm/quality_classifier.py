"""Quality scores by a support vector machine on naive Bayes features.

Features are n-gram indicators: byte trigrams, and bigrams of word shapes (letter case, symbols, length, same word as
before). Each indicator is scaled by its log count ratio between the classes; a linear hinge-loss model is fitted to that
by dual coordinate descent, and its margins, taken out of fold, are turned into probabilities.

Only the model is fitted on a bounded sample (``most`` labelled rows of each class); every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chain import fit_logistic, sigmoid
from .labelled import labelled_sample
from .shared import crc_mod, unused, with_text
from .textkit import Hasher, Runs, slices

GRAM_BITS, SHAPE_BITS = 16, 12
SIZE = (1 << GRAM_BITS) + (1 << SHAPE_BITS)
MOST = (3000, 3000)
C, EPOCHS, SMOOTH = 0.1, 15, 1.0
_LENGTH_BAND = np.digitize(np.arange(256), [2, 3, 4, 6, 9, 15, 30]).astype(np.int64)
#: Punctuation that stands for markup and tables.
_MARKUP = np.zeros(256, np.int64)
for _c in b"#*$%&|<>{}[]=_~^\\@":
    _MARKUP[_c] = 1


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the sorted numbers of the features it has."""
    seen = np.zeros(SIZE, bool)
    for _, _, buf, offs in slices(column):
        wide = buf.astype(np.uint32)
        grams = np.zeros(0, np.int64)
        if len(buf) > 2:
            code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
            grams = ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)
        shapes, bounds = _shapes(buf, offs)
        for i in range(len(offs) - 1):
            seen[grams[offs[i] : max(offs[i], offs[i + 1] - 2)]] = True
            seen[shapes[bounds[i] : bounds[i + 1]]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def _shapes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A feature for each word, from its shape and that of the word before it in the same text."""
    runs = Runs(buf, offs)
    s, e = runs.start, runs.end
    if not len(s):
        return np.zeros(0, np.int64), runs.bounds()

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[e] - sums[s]) / (e - s)

    upper, digit, markup = share((buf >= 65) & (buf <= 90)), share((buf >= 48) & (buf <= 57)), share(_MARKUP[buf])
    h = Hasher(buf).spans(s, e)
    same = np.zeros(len(s), bool)
    same[1:] = (h[1:] == h[:-1]) & (runs.row[1:] == runs.row[:-1])
    last = buf[e - 1]
    shape = _LENGTH_BAND[np.minimum(e - s, 255)]
    for part in (upper > 0, upper > 0.5, digit > 0, markup > 0, markup > 0.5, last == 33, same):
        shape = shape * 2 + part
    before = np.concatenate([[0], shape[:-1] + 1])
    before[np.flatnonzero(np.diff(runs.row, prepend=-1))] = 0
    code = (shape * 2051 + before).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << GRAM_BITS), runs.bounds()


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() + self.bias)

    def scores(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * np.array([self.margin(x) for x in indicators(column)]) + self.shift)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, SIZE), SMOOTH)
    for x, label in zip(rows, y, strict=True):
        counts[label, x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = C, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights (already times ``ratio``) and bias of min |w|^2 / 2 + sum of c_i * hinge loss; classes weigh the same."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, (y == 1).mean(), (y == 0).mean())
    limit = c / (2 * share)
    values = [ratio[x] for x in rows]
    square = np.array([v @ v + 1 for v in values])
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w * ratio, bias


def fit(rows: list[np.ndarray], y: np.ndarray, there: tuple[int, int]) -> Model:
    """``there``: how many rows of each class the sample stands for. With one class or none, a constant score."""
    y = np.asarray(y, int)
    n = np.bincount(y, minlength=2)
    if n.min() < 4:
        share = (there[1] + 1) / (sum(there) + 2)
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(y)) % 2
    for label in (0, 1):
        fold[y == label] = np.arange(n[label]) % 2
    margins = np.zeros(len(y))
    for k in (0, 1):
        some = np.flatnonzero(fold != k)
        part = [rows[i] for i in some]
        w, b = dual_coordinate_descent(part, y[some], log_count_ratio(part, y[some]))
        for i in np.flatnonzero(fold == k):
            margins[i] = w[rows[i]].sum() + b
    weight = np.where(y == 1, there[1] / n[1], there[0] / n[0])
    slope, shift = fit_logistic(np.stack([margins, np.ones(len(y))], 1), y, weight / weight.mean(), ridge=1e-3)
    w, b = dual_coordinate_descent(rows, y, log_count_ratio(rows, y))
    return Model(w, b, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] | None = (3, 1), most: tuple[int, int] = MOST) -> Model:
    """Fits on at most ``most`` labelled documents of each class; features are found in the workers.

    Rows without doc_id, null labels and labels other than 0 and 1 are left out; null and empty texts have no features; of
    several labels for one id the largest counts, and each row that repeats an id is a document of the sample. With fewer
    than four documents of a class, or empty tables, the model gives one constant score.
    """
    sample, there = labelled_sample(docs, labels, label, most, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x.astype(np.int32) for x in indicators(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "found"])

    t = sample.mapInArrow(run, "doc_id long, label int, found array<int>").toArrow().sort_by("doc_id")
    return fit([np.asarray(x.values) for x in t.column("found")], np.array(t.column("label").to_pylist(), int), there)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and the score (0 to 1) of every whole text.

    Null and empty texts get the score of no features; repeated rows get equal scores; an empty table gives no rows. Where
    ``keep`` has a column called ``name``, the new one has underscores after that (see ``unused``).
    """
    kept = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add(unused(keep, name), "double")

    rows, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(kept.value.scores(b.column(at)), pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows get equal scores, an empty table gives no rows."""
    scored = score(docs, train(docs, labels, "quality", held_out))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), "score", (scored["score"] >= threshold).cast("int").alias("predicted"))
