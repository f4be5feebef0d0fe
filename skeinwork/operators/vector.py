"""Embeddings and exact nearest neighbours by cosine distance."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import DIMENSION, TOKEN, bucket, tokenize
from .lexical import DIGITS, top_per_query
from .store import runs

MAX_QUERIES = 20_000
#: Tokens whose place a worker remembers at once.
KNOWN_TOKENS = 1 << 16
#: Distances that a task holds at once, and bytes of texts that it has embedded at once.
CELLS, TEXT_BYTES = 1 << 19, 1 << 20


class Embedder(Protocol):
    """What an embedding model must offer; it is loaded once in each worker."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Counts of hashed tokens: needs no model file and gives equal vectors everywhere."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension, self._known = dimension, {}

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for token in re.findall(TOKEN, text or ""):
                token = token.lower()
                at = self._known.get(token)
                if at is None:
                    if len(self._known) >= KNOWN_TOKENS:
                        self._known.clear()
                    at = self._known[token] = int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % self.dimension
                out[i, at] += 1
        return out


def embed(df: DataFrame, embedder: Embedder, text: str = "text", name: str = "embedding") -> DataFrame:
    """Adds the vectors of a text column, by runs of texts of TEXT_BYTES or of one longer text; null is the empty text."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            sizes = pc.binary_length(b).fill_null(0).to_numpy(zero_copy_only=False)
            rows = [np.asarray(embedder.encode([t or "" for t in b.slice(lo, hi - lo).to_pylist()]), np.float32) for lo, hi in runs(sizes, TEXT_BYTES)]
            ends = np.concatenate([[0], np.cumsum([len(r) for part in rows for r in part])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([part.ravel() for part in rows] or [np.zeros(0, np.float32)])))

    return df.withColumn(name, encode(text))


def hash_counts(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, bucket, n): the hashing embedding as rows."""
    return df.select(F.col(id_column).alias("id"), F.explode(tokenize(text)).alias("token")).groupBy("id", bucket(F.col("token")).alias("bucket")).agg(F.count("*").alias("n"))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine in double precision; a vector of zeros is at distance 1."""
    a, b = (F.transform(F.col(x) if isinstance(x, str) else x, lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def dimension_of(vectors: DataFrame, column: str = "embedding") -> int:
    """The common length of all vectors; ValueError where they differ."""
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions")
    return low or 0


def nearest_one(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, dist, rank from 1) of the k nearest to one vector: a distributed top-k without a shuffle of the rest."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.select("id", F.round(cosine_distance("embedding", q), DIGITS).alias("dist")).orderBy("dist", "id").limit(k)
    return top_per_query(near.withColumn("query_id", F.lit(0)), k, "dist", "id").drop("query_id")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, dist, rank from 1) of the k nearest of (id, embedding) to each of (query_id, embedding).

    The queries are sent to every task in blocks of MAX_QUERIES vectors, of which the driver holds one at a time; each batch of
    rows is a few matrix products a block and leaves k rows a query, of which the best are then taken, so what is shuffled
    follows batches and not pairs.
    """
    near = [_near(vectors, ids, matrix, queries.schema["query_id"].dataType.simpleString(), k) for ids, matrix in _blocks(queries)]
    return top_per_query(reduce(DataFrame.unionByName, near), k, "dist", "id")


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of at most MAX_QUERIES queries at a time; one empty block if there are none."""
    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    few = rows.limit(MAX_QUERIES + 1).toArrow()
    if few.num_rows <= MAX_QUERIES:
        yield few.column("query_id").combine_chunks(), _matrix(few.column("embedding"))
        return
    kind, left = to_arrow_type(queries.schema["query_id"].dataType), rows.toLocalIterator()
    while block := list(islice(left, MAX_QUERIES)):
        yield pa.array([r["query_id"] for r in block], kind), np.array([r["embedding"] for r in block], float)


def _near(vectors: DataFrame, ids: pa.Array, matrix: np.ndarray, kind: str, k: int) -> DataFrame:
    """(query_id, id, dist): of each batch of vectors the k nearest to each query of a block."""
    id_kind = vectors.schema["id"].dataType.simpleString()
    length = np.sqrt((matrix**2).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not len(length):
                continue
            x = _matrix(b.column("embedding"))
            norm = np.sqrt((x**2).sum(1))
            order = np.argsort(np.argsort(b.column("id").to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            few, step = min(k, b.num_rows), max(1, CELLS // b.num_rows)
            for lo in range(0, len(length), step):
                size = norm[None, :] * length[lo : lo + step, None]
                with np.errstate(invalid="ignore", divide="ignore"):
                    dist = np.round(np.where(size == 0, 1.0, 1 - (matrix[lo : lo + step] @ x.T) / size), DIGITS)
                best = np.stack([np.lexsort((order, row))[:few] for row in dist])
                query = np.repeat(np.arange(lo, lo + len(dist)), few)
                yield pa.RecordBatch.from_arrays([pa.array(ids.take(pa.array(query))), b.column("id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(dist, best, 1).ravel())], names=["query_id", "id", "dist"])

    return vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"query_id {kind}, id {id_kind}, dist double")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
