"""Whitening of embeddings by their exact scatter.

Vectors become integers (``SCALE`` steps to the unit), so that sums and products of them have no rounding at all. Each task
subtracts a shift, multiplies its distinct vectors by matrix products of limbs that a double holds exactly, and adds up
integers of any size; tasks are added row by row of the matrix in the shuffle. What reaches the driver is a matrix of the
dimension squared, whatever the number of vectors. There n·XᵀX − SSᵀ is formed exactly, and only then divided and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import unused

SCALE = 256
#: Products of two limbs, summed over ROWS vectors, stay below 2**53.
LIMB, ROWS = 20, 1 << 13
#: Components whose share of the variance is below this are rounding of zero.
LEAST_SHARE = 1e-14
_LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """Of n distinct vectors with sums S: ``scatter`` is n·XᵀX − SSᵀ as integers, so that the covariance is scatter / n²."""

    n: int
    sums: list[int]
    scatter: np.ndarray
    values: np.ndarray  # falling eigenvalues of the covariance, those over zero
    components: np.ndarray  # unit columns beside them
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]


def integer_vector(column: str | Column) -> Column:
    """array<long> of floor(SCALE * entry), or null where the vector is null or an entry is null or not finite.

    Entries beyond the range of long take its ends.
    """
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(sound, F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long")))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, int64 matrix) of the vectors of each length, ROWS at a time."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    length = np.diff(offsets)
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            yield part, flat[offsets[part][:, None] + np.arange(d)]


def exact_product(y: np.ndarray) -> np.ndarray:
    """yᵀy of at most ROWS rows of int64, as an object matrix of Python integers."""
    limbs, rest = [], y
    while True:
        if not len(rest) or (int(rest.max()) < 1 << LIMB and int(rest.min()) >= -(1 << LIMB)):
            limbs.append(rest.astype(np.float64))
            break
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)) if i + j else (a.T @ b).astype(np.int64).astype(object)
    return out


def _exact_sums(y: np.ndarray) -> np.ndarray:
    low = (y & ((1 << 32) - 1)).sum(axis=0).astype(object)
    return low + (((y >> 32).sum(axis=0)).astype(object) << 32)


class _Scatter:
    """Number, sums and products of vectors of one length, taken around the first of them and given without that shift."""

    def __init__(self, first: np.ndarray):
        self.shift = first if int(np.abs(first.astype(np.float64)).max(initial=0)) < 1 << 60 else np.zeros_like(first)
        self.n, self.sums, self.products = 0, np.zeros(len(first), object), np.zeros((len(first), len(first)), object)

    def add(self, x: np.ndarray) -> None:
        if np.abs(x.astype(np.float64)).max(initial=0) >= 1 << 60:
            shift, y = np.zeros_like(self.shift), x
        else:
            shift, y = self.shift, x - self.shift
        m, s, p = len(x), _exact_sums(y), exact_product(y)
        c = shift.astype(object)
        self.n += m
        self.products += p + np.outer(c, s) + np.outer(s, c) + np.outer(c, c) * m
        self.sums += s + c * m

    def rows(self) -> Iterator[tuple[int, list[str]]]:
        """(i, decimal texts of n, the sum of i, and its products with itself and those after it)."""
        for i in range(len(self.sums)):
            yield i, [str(self.n), str(self.sums[i]), *map(str, self.products[i, i:])]


_PARTS = "dimension int, i int, parts array<string>"
_ARROW = pa.schema([("dimension", pa.int32()), ("i", pa.int32()), ("parts", pa.list_(pa.string()))])


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, _Scatter] = {}
    for b in batches:
        for _, x in _matrices(b.column(0)):
            if x.shape[1]:
                found.setdefault(x.shape[1], _Scatter(x[0])).add(x)
    for d, s in found.items():
        for i, parts in s.rows():
            yield pa.RecordBatch.from_pylist([{"dimension": d, "i": i, "parts": parts}], _ARROW)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], list[int]] = {}
    for b in batches:
        for r in b.to_pylist():
            key, parts = (r["dimension"], r["i"]), map(int, r["parts"])
            total[key] = [a + p for a, p in zip(total[key], parts, strict=True)] if key in total else list(parts)
    for (d, i), parts in total.items():
        yield pa.RecordBatch.from_pylist([{"dimension": d, "i": i, "parts": [str(p) for p in parts]}], _ARROW)


def fit(vectors: DataFrame, column: str = "embedding", most: int | None = None) -> Whitening | None:
    """The whitening of the distinct integer vectors of ``column``, with all components of a positive eigenvalue or the first ``most``.

    Equal vectors count once, however many rows hold them. Null vectors and those with null or non-finite entries are left
    out; of vectors of several lengths the commonest length counts (the longer of two as common). Without vectors there is
    none (None); vectors that are all equal have no component.
    """
    distinct = vectors.select(integer_vector(column).alias("x")).filter("x IS NOT NULL").distinct()
    parts = distinct.mapInArrow(_scattered, _PARTS).repartition("dimension", "i").mapInArrow(_added, _PARTS)
    rows = {(r["dimension"], r["i"]): [int(p) for p in r["parts"]] for r in parts.collect()}  # dimension squared / 2 integers
    if not rows:
        return None
    d = max((r[0], k[0]) for k, r in rows.items())[1]
    n, sums, products = rows[d, 0][0], [rows[d, i][1] for i in range(d)], np.zeros((d, d), object)
    for i in range(d):
        products[i, i:] = products[i:, i] = rows[d, i][2:]
    s = np.array(sums, object)
    return decompose(n, sums, products * n - np.outer(s, s), most)


def decompose(n: int, sums: list[int], scatter: np.ndarray, most: int | None = None) -> Whitening:
    """Divides the exact scatter by n², each entry rounded once, and takes its eigenvectors; measures what they whiten to."""
    square = n * n
    covariance = np.array([[v / square for v in row] for row in scatter], np.float64)
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components[:, ::-1]
    trace = sum(scatter[i, i] for i in range(len(sums))) / square
    k = int(np.sum(values > max(trace, 0) * LEAST_SHARE))
    k = k if most is None else min(k, most)
    values, components = values[:k], np.ascontiguousarray(components[:, :k])
    return Whitening(n, sums, scatter, values, components, trace, _identity_error(square, scatter, components / np.sqrt(values)))


def _identity_error(square: int, scatter: np.ndarray, w: np.ndarray) -> float:
    """Largest entry of WᵀVW − I, with the exact V and W rounded to 2**-80 of its largest entry."""
    if not w.size:
        return 0.0
    bits = 80 - int(np.floor(np.log2(np.abs(w).max())))
    whole = np.array([[int(np.ldexp(v, 52 - e)) << (bits - 52 + e) if bits - 52 + e >= 0 else int(np.ldexp(v, 52 - e)) >> (52 - e - bits) for v, e in zip(row, np.frexp(row)[1].tolist(), strict=True)] for row in w], object)
    c = whole.T.dot(scatter).dot(whole)
    one = square << (2 * bits)
    return float(max(abs(c[i, j] - (one if i == j else 0)) / one for i in range(len(c)) for j in range(len(c))))


def whiten(vectors: DataFrame, model: Whitening, keep: tuple[str, ...] = ("vec_id",), column: str = "embedding") -> DataFrame:
    """``keep``, deviation and whitened (array<double>, one value a component) of every row that ``fit`` would take.

    ``deviation`` is the sum of (n·x − S)² over the dimensions, exactly; null where that is beyond long. Names that are taken
    get an underscore. Repeated rows fare alike; rows of another length than the model's are left out.
    """
    deviation = unused(keep, "deviation")
    whitened, vector = unused([*keep, deviation], "whitened"), unused(keep, "x")
    rows = vectors.select(*keep, integer_vector(column).alias(vector)).filter(F.size(vector) == len(model.sums))
    n, sums, w, place = model.n, model.sums, model.components / (np.sqrt(model.values) * float(model.n)), len(keep)
    highest, k = max(map(abs, sums), default=0), model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _matrices(b.column(place)):
                most = int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
                if n * most + highest < _LONG:
                    away = x * n - np.array(sums, np.int64)
                else:
                    away = x.astype(object) * n - np.array(sums, object)
                if (n * most + highest) ** 2 * max(1, x.shape[1]) < _LONG:
                    square = pa.array((away * away).sum(axis=1), pa.int64())
                else:
                    away = away.astype(object)
                    square = pa.array([v if v < _LONG else None for v in (away * away).sum(axis=1).tolist()], pa.int64())
                out = away.astype(np.float64) @ w
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), pa.array(out.ravel(), pa.float64()))
                kept = [b.column(j).take(pa.array(part)) for j in range(place)]
                yield pa.RecordBatch.from_arrays([*kept, square, lists], names=[*keep, deviation, whitened])

    kinds = [T.StructField(f.name, f.dataType) for f in vectors.select(*keep).schema]
    return rows.mapInArrow(run, T.StructType([*kinds, T.StructField(deviation, T.LongType()), T.StructField(whitened, T.ArrayType(T.DoubleType()))]))


def whitened_rows(vectors: DataFrame, first: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and each of the first components.

    No vectors, or none but equal ones, give no rows; repeated rows are given as often.
    """
    model = fit(vectors, most=first)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(v) for v in model.explained])
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
