"""Queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, graph
from ..operators.store import written
from .parts import EDGES_SQL, RELATED_SQL, benchmark_queries, entities_sql, hybrid_sql, table
from .retrieval import hybrid


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.extract(table(spark, sf_dir, "documents"), "doc_id")


def kg_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mentions(_lists(spark, sf_dir)).select("entity", F.col("id").alias("doc_id"))


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(_lists(spark, sf_dir), count=table(spark, sf_dir, "documents").count())


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges, written once where a plan reads them several times."""
    return written(kg_edges(spark, sf_dir), "edges")


def kg_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(kg_edges(spark, sf_dir))


def kg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(_edges(spark, sf_dir), graph.mentions(_lists(spark, sf_dir)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = graph.extract(table(spark, sf_dir, "benchmark"), "item_id")
    return asked.select(F.col("id").alias("query_id"), F.explode("entities").alias("entity"))


def kg_related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.related(_edges(spark, sf_dir), _asked(spark, sf_dir))
    return found.select("query_id", "entity", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def kg_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.related(_edges(spark, sf_dir), _asked(spark, sf_dir), max_hops=2, top_k=15)
    return found.select("query_id", "entity", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = graph.related(_edges(spark, sf_dir), _asked(spark, sf_dir)).filter("rank <= 8")
    return graph.chunks_by_entities(near, graph.mentions(_lists(spark, sf_dir)))


def kg_chunks_by_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph_hits(spark, sf_dir).select("query_id", F.col("id").alias("doc_id"), "hits", F.col("rank").cast("long").alias("rank"))


def graph_augmented_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse_with_graph(hybrid(spark, sf_dir, benchmark_queries(spark, sf_dir), 20), _graph_hits(spark, sf_dir))
    return fused.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def kg_order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pair_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


QUERIES = {f.__name__: f for f in (kg_mentions, kg_edges, kg_degree, kg_stats, kg_related_entities, kg_two_hops, kg_chunks_by_entities, graph_augmented_retrieve, kg_order_parts)}

_ENT = entities_sql("documents", "doc_id", "text", "ent")
ORACLES = {
    "kg_mentions": f"WITH {_ENT} SELECT entity, id AS doc_id FROM ent",
    "kg_edges": f"WITH {EDGES_SQL} SELECT * FROM edges",
    "kg_degree": f"WITH {EDGES_SQL} SELECT entity, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT u AS entity, weight FROM edges UNION ALL SELECT v, weight FROM edges) GROUP BY 1",
    "kg_stats": f"""WITH {EDGES_SQL} SELECT (SELECT count(*) FROM (SELECT u FROM edges UNION SELECT v FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges,
(SELECT count(DISTINCT entity) FROM ent) AS entities, (SELECT count(DISTINCT id) FROM ent) AS chunks""",
    "kg_related_entities": f"WITH {RELATED_SQL} SELECT query_id, entity, round(score, 6) AS score, rank FROM related",
    "kg_two_hops": f"""WITH {RELATED_SQL},
far AS (SELECT n.query_id, b AS entity, max(weight) / 3.0::DOUBLE AS score FROM (SELECT * FROM near ANTI JOIN seed USING (query_id, entity)) n JOIN both_ ON a = n.entity GROUP BY ALL),
more AS (SELECT * FROM seen UNION ALL SELECT * FROM far ANTI JOIN seen USING (query_id, entity))
SELECT query_id, entity, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity) AS rank FROM more) WHERE rank <= 15""",
    "kg_chunks_by_entities": f"WITH {RELATED_SQL} SELECT query_id, id AS doc_id, hits, rank FROM ghits",
    "graph_augmented_retrieve": f"""WITH {hybrid_sql(20)}, {RELATED_SQL},
fused AS (SELECT query_id, id, round(sum(part), 9) AS score, min(g) AS g, min(h) AS h FROM (
  SELECT query_id, id, 0.7::DOUBLE * score AS part, NULL::BIGINT AS g, rank AS h FROM rrf UNION ALL SELECT query_id, id, 0.3::DOUBLE / rank, rank, NULL FROM ghits) GROUP BY ALL)
SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, g NULLS LAST, h NULLS LAST) AS rank FROM fused) WHERE rank <= 20""",
    "kg_order_parts": """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT a.l_partkey AS u, b.l_partkey AS v, count(*) AS weight FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) >= 2""",
}
