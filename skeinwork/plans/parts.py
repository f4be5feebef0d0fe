"""Pieces that several queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.build_index(lexical.tokens_of(table(spark, sf_dir, "documents"), "doc_id"))


TOKEN_SQL = r"[a-zA-Z]+[0-9]*|[0-9]+(?:\.[0-9]+)?|[\x{4e00}-\x{9fff}]+"


def tokens_sql(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{TOKEN_SQL}'), lambda t: lower(t))"


#: toks(id, ts), dl, tf, stats, idf: the lexical index.
INDEX_SQL = f"""
toks AS MATERIALIZED (SELECT doc_id AS id, {tokens_sql("text")} AS ts FROM documents),
dl AS (SELECT id, len(ts) AS dl FROM toks),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM toks) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM raw) END AS idf FROM raw)"""


def bm25_sql(queries: str, k: int, name: str = "lex") -> str:
    """CTEs after INDEX_SQL; ``queries`` is a relation (query_id, query); makes ``name`` (query_id, id, score, rank)."""
    return f"""
{name}_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens_sql("query")}) AS term FROM {queries}) GROUP BY ALL),
{name}_s AS (SELECT query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM {name}_q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (id), stats GROUP BY ALL),
{name}_a AS (SELECT q.query_id, d.id, round(coalesce(s, 0), 9) AS score FROM {queries} q CROSS JOIN dl d LEFT JOIN {name}_s s ON s.query_id = q.query_id AND s.id = d.id),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_a) WHERE rank <= {k})"""


def embedding_sql(relation: str, id_column: str, text: str, name: str) -> str:
    """``name`` (id, embedding): the hashing embedding of each row of a relation."""
    return f"""
{name}_c AS (SELECT id, b, count(*) AS n FROM (SELECT {id_column} AS id, ('0x' || substr(md5(t), 1, 4))::INT % 64 AS b
  FROM (SELECT {id_column}, unnest({tokens_sql(text)}) AS t FROM {relation})) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT r.id, list(coalesce(n, 0)::DOUBLE ORDER BY g.b) AS embedding
  FROM (SELECT {id_column} AS id FROM {relation}) r CROSS JOIN (SELECT unnest(range(64))::INT AS b) g LEFT JOIN {name}_c c ON c.id = r.id AND c.b = g.b GROUP BY r.id)"""


def nearest_sql(vectors: str, queries: str, k: int, name: str = "sem") -> str:
    """``name`` (query_id, id, dist, rank) from relations (id, embedding DOUBLE[])."""
    return f"""
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (
  SELECT q.id AS query_id, v.id, round(CASE WHEN sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(v.embedding, v.embedding)) = 0 THEN 1
    ELSE 1 - list_dot_product(q.embedding, v.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(v.embedding, v.embedding))) END, 9) AS dist
  FROM {vectors} v CROSS JOIN {queries} q)) WHERE rank <= {k})"""


def rrf_sql(sem: str, lex: str, name: str = "rrf", anchors: str | None = None) -> str:
    """``name`` (query_id, id, score, sem, lex, rank); ``anchors`` is a relation (id)."""
    boost = f"* CASE WHEN id IN (SELECT id FROM {anchors}) THEN 2.0 ELSE 1.0 END" if anchors else ""
    return f"""
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sem NULLS LAST, lex NULLS LAST) AS rank FROM (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (29 + coalesce(sem, lex))) {boost}, 9) AS score, min(sem) AS sem, min(lex) AS lex FROM (
    SELECT query_id, id, rank AS sem, NULL AS lex FROM {sem} UNION ALL SELECT query_id, id, NULL, rank FROM {lex}) GROUP BY query_id, id))"""


#: hybrid retrieval of all benchmark texts with k = 70: makes rrf.
BENCH_SQL = "bench AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def hybrid_sql(k: int = 70, name: str = "rrf", anchors: str | None = None) -> str:
    return ",".join([INDEX_SQL, BENCH_SQL, bm25_sql("bench", k), embedding_sql("documents", "doc_id", "text", "dvec"), embedding_sql("bench", "query_id", "query", "qvec"), nearest_sql("dvec", "qvec", k), rrf_sql("sem", "lex", name, anchors)])


ENTITY_SQL = "[A-Z][a-z]{4,}"


def entities_sql(relation: str, id_column: str, text: str, name: str) -> str:
    """``name`` (id, entity, k): distinct entities in order of first appearance, k from 1."""
    return f"""
{name} AS MATERIALIZED (SELECT id, entity, row_number() OVER (PARTITION BY id ORDER BY p) AS k FROM (
  SELECT id, e[i] AS entity, min(i) AS p FROM (SELECT id, e, unnest(range(1, len(e) + 1)) AS i FROM (
    SELECT {id_column} AS id, regexp_extract_all(coalesce({text}, ''), '{ENTITY_SQL}') AS e FROM {relation})) GROUP BY ALL))"""


EDGES_SQL = f"""
{entities_sql("documents", "doc_id", "text", "ent")},
edges AS MATERIALIZED (SELECT least(a.entity, b.entity) AS u, greatest(a.entity, b.entity) AS v, count(*) AS weight
  FROM ent a JOIN ent b ON a.id = b.id AND a.k < b.k WHERE a.k <= 20 AND b.k <= 20 GROUP BY ALL HAVING count(*) >= 2)"""

RELATED_SQL = f"""
{EDGES_SQL},
both_ AS (SELECT u AS a, v AS b, weight FROM edges UNION ALL SELECT v, u, weight FROM edges),
named AS (SELECT lower(a) AS low, max(a) AS entity FROM both_ GROUP BY 1),
{entities_sql("benchmark", "item_id", "text", "qent")},
seed AS (SELECT DISTINCT q.id AS query_id, n.entity FROM qent q JOIN named n ON lower(q.entity) = n.low),
near AS (SELECT query_id, b AS entity, max(weight) / 2.0::DOUBLE AS score FROM seed JOIN both_ ON a = entity GROUP BY ALL),
seen AS (SELECT query_id, entity, 2.0::DOUBLE AS score FROM seed UNION ALL SELECT * FROM near ANTI JOIN seed USING (query_id, entity)),
related AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entity) AS rank FROM seen) WHERE rank <= 10),
ghits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM (
  SELECT query_id, id, count(*) AS hits FROM related JOIN ent USING (entity) WHERE related.rank <= 8 GROUP BY ALL)) WHERE rank <= 10)"""
