"""Approximate nearest neighbours: inverted lists of vectors around centroids, probed and ranked again exactly.

The centroids, and how many lists a query needs, are fitted on a bounded sample. Every vector is put into the list of its
nearest centroid; lists are dealt out in blocks of bounded size, so that a list with a third of all vectors is many blocks.
A query goes to the blocks of its nearest lists, where the exact distances leave k rows; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import DIGITS, top_per_query
from .store import written
from .vector import _matrix

#: Vectors that centroids are fitted on at most, those of them that are asked for to see how many lists a query needs, rounds
#: of fitting, lists at most, and vectors of a block.
SAMPLE, ASKED, ROUNDS, MOST_LISTS, BLOCK = 20_000, 400, 8, 4_096, 1 << 14
#: Recall on the sample that the number of probed lists is chosen for.
TARGET = 0.97


@dataclass(frozen=True)
class Lists:
    """``rows`` (list, block, id, embedding) of all vectors, ``blocks`` (list, blocks), unit ``centroids``, and lists to probe."""

    rows: DataFrame
    blocks: DataFrame
    centroids: np.ndarray
    probes: int

    def save(self, path: str) -> None:
        """Writes the lists, each in files of its own range, and the centroids beside them."""
        self.rows.repartitionByRange("list", "block").sortWithinPartitions("list", "block").write.parquet(f"{path}/rows")
        self.blocks.write.parquet(f"{path}/blocks")
        spark = self.rows.sparkSession
        data = [(i, [float(v) for v in c], self.probes) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(data, "list int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Lists:
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MOST_LISTS
        centroids = np.array([r["centroid"] for r in found], float) if found else np.zeros((0, 0))
        return Lists(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks"), centroids, found[0]["probes"] if found else 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    size = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x, dtype=float), where=size > 0)


def centroids_of(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors by rounds of assignment and means; a list that loses all takes a vector far from its own."""
    r = np.random.Generator(np.random.PCG64(seed))
    c = x[r.permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        near = x @ c.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


def probes_needed(x: np.ndarray, c: np.ndarray, k: int, target: float) -> int:
    """The least number of lists that finds the target share of the k nearest, for vectors of the sample among the sample."""
    asked = x[: min(ASKED, len(x))]
    own = (x @ c.T).argmax(axis=1)
    k = min(k, len(x))
    near = np.argpartition(-(asked @ x.T), k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)  # of each list for each query
    found = np.take_along_axis(order, own[near], axis=1)
    shares = np.array([(found < p).mean() for p in range(1, len(c) + 1)])
    return int(np.argmax(shares >= target)) + 1 if (shares >= target).any() else len(c)


def build_lists(vectors: DataFrame, k: int = 10, target: float = TARGET, sample: int = SAMPLE, lists: int | None = None, block: int = BLOCK) -> Lists:
    """Lists of (id, embedding): about as many as the square root of the number of vectors.

    Centroids are fitted on at most ``sample`` vectors, chosen by a hash of their id, but every vector is listed; null vectors
    are in no list, and vectors of zeros are in one as any. Vectors have one length.
    """
    rows = vectors.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    few = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("embedding")) if n else np.zeros((0, 0))
    x = unit(few)
    many = min(lists or isqrt(n), MOST_LISTS, max(1, len(x) // 4)) if n else 0
    centroids = centroids_of(x, many) if n else x
    assigned = written(rows.mapInArrow(_assigner(centroids), f"list int, id {rows.schema['id'].dataType.simpleString()}, embedding array<double>"), "lists")
    blocks = assigned.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = assigned.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))  # at most MOST_LISTS rows
    return Lists(dealt.select("list", "block", "id", "embedding"), blocks, centroids, probes_needed(x, centroids, k, target) if n else 0)


def _assigner(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = (unit(_matrix(b.column("embedding"))) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column("id"), b.column("embedding")], names=["list", "id", "embedding"])

    return run


def nearest_in_lists(index: Lists, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, id, dist, rank from 1) of about the k nearest to each of (query_id, embedding), by exact cosine distance within
    the lists of the ``probes`` nearest centroids.

    Vectors of one block and its queries meet in one task; a block's vectors are held, its queries pass in batches.
    """
    probes = min(probes or index.probes, len(index.centroids))
    kind, id_kind = (d.simpleString() for d in (queries.schema["query_id"].dataType, index.rows.schema["id"].dataType))
    empty = f"query_id {kind}, id {id_kind}, dist double, rank int"
    if not probes:
        return queries.sparkSession.createDataFrame([], empty)
    asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    goes = asked.mapInArrow(_prober(index.centroids, probes), f"query_id {kind}, embedding array<double>, list int")
    goes = goes.join(F.broadcast(index.blocks), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", F.lit(None).cast(id_kind).alias("id"), "embedding", F.lit(1).alias("asks"))
    both = index.rows.select("list", "block", F.lit(None).cast(kind).alias("query_id"), "id", "embedding", F.lit(0).alias("asks")).unionByName(goes)
    met = both.repartition("list", "block").sortWithinPartitions("list", "block", "asks", "id").mapInArrow(_meeting(k), f"query_id {kind}, id {id_kind}, dist double")
    return top_per_query(met, k, "dist", "id")


def _prober(centroids: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(unit(_matrix(b.column("embedding"))) @ centroids.T), axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(b.num_rows), probes))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(row), b.column("embedding").take(row), pa.array(near.ravel().astype(np.int32))], names=["query_id", "embedding", "list"])

    return run


def _meeting(k: int):
    """Rows of whole blocks in order, the vectors of each before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors = None, [], []
        x, held = np.zeros((0, 0)), None
        for b in batches:
            place = np.stack([b.column("list").to_numpy(), b.column("block").to_numpy(), b.column("asks").to_numpy()])
            cuts = np.append(np.flatnonzero(np.diff(place, axis=1, prepend=-1).any(axis=0)), b.num_rows)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part, spot = b.slice(lo, hi - lo), tuple(place[:2, lo].tolist())
                if spot != here:
                    here, ids, vectors, held = spot, [], [], None
                if not place[2, lo]:
                    ids.append(part.column("id"))
                    vectors.append(_matrix(part.column("embedding")))
                elif ids:
                    if held is None:
                        held, x = pa.concat_arrays(ids), np.concatenate(vectors)
                    yield _best(part.column("query_id"), _matrix(part.column("embedding")), held, x, k)

    return run


def _best(query: pa.Array, asked: np.ndarray, ids: pa.Array, x: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of a block for some queries; ids are in order, so that equal distances go by id."""
    few, out = min(k, len(x)), []
    norm, length = np.sqrt((x**2).sum(axis=1)), np.sqrt((asked**2).sum(axis=1))
    for lo in range(0, len(asked), 256):
        size = norm[None, :] * length[lo : lo + 256, None]
        with np.errstate(invalid="ignore", divide="ignore"):
            dist = np.round(np.where(size == 0, 1.0, 1 - (asked[lo : lo + 256] @ x.T) / size), DIGITS)
        best = np.argsort(dist, axis=1, kind="stable")[:, :few]
        out.append((best, np.take_along_axis(dist, best, axis=1)))
    best, dist = (np.concatenate([o[i] for o in out]).ravel() for i in (0, 1))
    return pa.RecordBatch.from_arrays([query.take(pa.array(np.repeat(np.arange(len(asked)), few))), ids.take(pa.array(best)), pa.array(dist)], names=["query_id", "id", "dist"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of exact neighbours that were found; one as near as the last exact one counts as it."""
    last = exact.groupBy("query_id").agg(F.max("dist").alias("last"), F.count("*").alias("n"))
    hits = found.join(last, "query_id").groupBy("query_id").agg(F.least(F.count_if(F.col("dist") <= F.col("last")), F.max("n")).alias("hits"))
    return last.join(hits, "query_id", "left").agg(F.count("*").alias("queries"), (F.sum(F.coalesce("hits", F.lit(0))) / F.sum("n")).alias("recall"))
