"""Retrieval quality: recall, reciprocal rank, nDCG, their means, and gates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BENCHMARK
from .store import written

#: Queries without an inner word that are searched for at once.
BLOCK = 500


def holders(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) of the documents (id, text) that hold a query (query_id, query) verbatim; null texts hold none.

    A text that holds a query holds its inner words (those with a space on both sides) as words of its own. Documents are
    looked up by the rarest such word of a query, and only those that have it are searched. Queries without an inner word
    are searched for in all documents, ``BLOCK`` of them at a time.
    """
    words = lambda c: F.split(c, " ")
    inner = F.array_distinct(F.expr("slice(w, 2, greatest(size(w) - 2, 0))"))
    q = queries.select("query_id", "query", words(F.col("query")).alias("w")).select("query_id", "query", F.explode_outer(inner).alias("word"))
    asked = q.select("word").distinct().filter("word IS NOT NULL")
    held = written(docs.filter("text IS NOT NULL").select("id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(asked, "word"), "held")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    rarest = q.join(counts, "word", "left").groupBy("query_id", "query").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    looked_up = held.join(rarest.filter("word IS NOT NULL"), "word").select("query_id", "query", "id")
    found = looked_up.join(docs.select("id", "text"), "id").filter(F.contains("text", "query")).select("query_id", "id")
    short = iter(rarest.filter("word IS NULL").select("query_id", "query").toLocalIterator())
    kind = f"struct<query_id:{queries.schema['query_id'].dataType.simpleString()},query:string>"
    while block := list(islice(short, BLOCK)):
        asked = F.array(*[F.struct(F.lit(r[0]).alias("query_id"), F.lit(r[1]).alias("query")).cast(kind) for r in block])
        hits = docs.select("id", F.explode(F.filter(asked, lambda x: F.contains(F.col("text"), x["query"]))).alias("q"))
        found = found.unionByName(hits.select("q.query_id", "id"))
    return found.distinct()


def per_query(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, reciprocal_rank, ndcg): ranked is (query_id, id, rank from 1), relevant (query_id, id).

    Starts from the queries, so those without a result count; a query without relevant chunks has recall and reciprocal rank
    1 and nDCG 1. A chunk listed twice counts twice in the gain and once in the recall.
    """
    n = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.join(relevant.distinct().withColumn("hit", F.lit(True)), ["query_id", "id"])
    found = hits.groupBy("query_id").agg(
        F.count_distinct(F.when(F.col("rank") <= k, F.col("id"))).alias("found"),
        F.min("rank").alias("first"),
        F.coalesce(F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("gain"),
    )
    ideal = F.when(F.least("n", F.lit(k)) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n").cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1)))
    out = queries.select("query_id").join(n, "query_id", "left").join(found, "query_id", "left")
    none = F.col("n").isNull()
    return out.select(
        "query_id",
        F.when(none, 1.0).otherwise(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0))).alias("recall"),
        F.when(none, 1.0).otherwise(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(none, 1.0).otherwise(F.coalesce(F.col("gain") / ideal, F.lit(0.0))).alias("ndcg"),
    )


def means(scores: DataFrame) -> DataFrame:
    """One row: queries, recall, mrr, ndcg; zeros where there is no query."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scores.agg(F.count("*").alias("queries"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean("ndcg").alias("ndcg"))


def run_benchmark(cases: DataFrame, retrieve: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """Means over all cases (query_id, query, relevant array) of one batch retrieval."""
    relevant = cases.select("query_id", F.explode("relevant").alias("id"))
    return means(per_query(cases, retrieve(cases.select("query_id", "query")), relevant, k))


def failed_gates(metrics: DataFrame, gates: dict[str, float]) -> DataFrame:
    """(metric, value, minimum) of gates that aren't met; a metric that isn't there counts as 0."""
    known = [c for c in gates if c in metrics.columns]
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double") if c in known else F.lit(0.0)
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), value(c).alias("value"), F.lit(float(v)).alias("minimum")) for c, v in sorted(gates.items())])
    return metrics.select(F.explode(rows).alias("g")).select("g.*").filter("value < minimum")


def assert_gates(metrics: DataFrame, gates: dict[str, float]) -> None:
    if failed := failed_gates(metrics, gates).collect():
        raise AssertionError("; ".join(f"{r['metric']} {r['value']:.4f} < {r['minimum']}" for r in failed))


@dataclass(frozen=True)
class Benchmark:
    """A benchmark file: ``cases`` (query_id, query, relevant), ``corpus`` (chunk_id, text), k and the gates of the means."""

    cases: DataFrame
    corpus: DataFrame
    k: int
    gates: dict[str, float]


def read_benchmark(spark: SparkSession, path: str) -> Benchmark:
    """Reads a benchmark file, an object with a list of cases, from any file system; ValueError where it isn't one."""
    whole = spark.read.option("multiLine", True).schema(BENCHMARK).json(path)
    heads = whole.select("k", "quality_gates", F.col("cases").isNotNull().alias("sound")).limit(2).collect()
    if len(heads) != 1 or not heads[0]["sound"]:
        raise ValueError(f"{path} has no list of cases")
    cases = whole.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("query_id"), "c.query", F.col("c.relevant_chunk_ids").alias("relevant"))
    return Benchmark(cases, whole.select(F.explode("corpus").alias("c")).select("c.chunk_id", "c.text"), heads[0]["k"] or 3, heads[0]["quality_gates"] or {})
