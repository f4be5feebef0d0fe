"""Rank fusion, adaptive cut-off and refusal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import DIGITS, top_per_query
from .store import union


def reciprocal_ranks(semantic: DataFrame, lexical: DataFrame, k: int = 30, anchors: DataFrame | None = None, boost: float = 2.0) -> DataFrame:
    """(query_id, id, score, rank from 1) of both lists together: the sum of 1 / (k + rank from 0).

    Lists are (query_id, id, rank from 1). Ids in ``anchors`` get ``boost`` times their score. Ties go by the place in the
    semantic list, then in the lexical one.
    """
    both = semantic.select("query_id", "id", F.col("rank").alias("sem"), F.lit(None).cast("int").alias("lex"))
    both = union(both, lexical.select("query_id", "id", F.lit(None).cast("int").alias("sem"), F.col("rank").alias("lex")), "query_id")
    part = F.lit(1.0) / (k - 1 + F.coalesce("sem", "lex"))
    fused = both.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.min("sem").alias("sem"), F.min("lex").alias("lex"))
    if anchors is not None:
        marked = anchors.select("id").distinct().withColumn("anchor", F.lit(True))
        fused = fused.join(marked, "id", "left").withColumn("score", F.when(F.col("anchor"), F.col("score") * boost).otherwise(F.col("score"))).drop("anchor")
    fused = fused.withColumn("score", F.round("score", DIGITS))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("sem"), F.asc_nulls_last("lex")))
    return fused.withColumn("rank", rank)


def merge_sub_queries(ranked: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, id, score, rank): for each question, the best score of each chunk over its sub-queries.

    ``parents`` maps sub-queries (query_id) to questions (parent_id).
    """
    best = ranked.join(parents, "query_id").groupBy(F.col("parent_id").alias("query_id"), "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))


def dynamic_top_k(ranked: DataFrame, min_k: int, max_k: int) -> DataFrame:
    """(query_id, k): cut at the first largest drop between adjoining scores from min_k on; all of at most min_k results.

    Without a drop k is max_k, or the number of results where that is smaller. A query without results has no row.
    """
    step = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank")) - F.col("score")
    gaps = ranked.select("query_id", (F.col("rank") - 1).alias("at"), step.alias("gap"))
    usable = (F.col("gap") > 0) & (F.col("at") >= min_k) & (F.col("at") < max_k)
    cut = F.max(F.when(usable, F.struct("gap", (-F.col("at")).alias("at"))))
    found = gaps.groupBy("query_id").agg(F.count("*").alias("n"), cut.alias("cut"))
    k = F.when(F.col("n") <= min_k, F.col("n")).otherwise(F.least("n", F.coalesce(-F.col("cut.at"), F.lit(max_k))))
    return found.select("query_id", k.cast("int").alias("k"))


def cut(ranked: DataFrame, min_k: int, max_k: int) -> DataFrame:
    return ranked.join(dynamic_top_k(ranked, min_k, max_k), "query_id").filter("rank <= k").drop("k")


def refusals(queries: DataFrame, ranked: DataFrame, threshold: float = 0.03) -> DataFrame:
    """(query_id, refused): whether the best score is under the threshold or there is none."""
    best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce(F.col("best") < threshold, F.lit(True)).alias("refused"))


def fuse_with_graph(hybrid: DataFrame, graph: DataFrame, alpha: float = 0.7, keep: int = 20) -> DataFrame:
    """(query_id, id, score, rank): alpha times the hybrid score plus (1 - alpha) / graph rank; the first ``keep``."""
    h = hybrid.select("query_id", "id", (alpha * F.col("score")).alias("part"), F.lit(None).cast("int").alias("g"), F.col("rank").alias("h"))
    g = graph.select("query_id", "id", ((1 - alpha) / F.col("rank")).alias("part"), F.col("rank").alias("g"), F.lit(None).cast("int").alias("h"))
    both = union(h, g, "query_id").groupBy("query_id", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.min("g").alias("g"), F.min("h").alias("h"))
    return top_per_query(both, keep, F.desc("score"), F.asc_nulls_last("g"), F.asc_nulls_last("h")).select("query_id", "id", "score", "rank")
