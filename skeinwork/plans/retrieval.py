"""Queries over tokens, the lexical index, vectors, and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import should_decompose, tokenize
from ..operators import ann, fusion, lexical, vector
from ..operators.store import spread

from .parts import BENCH_SQL, INDEX_SQL, benchmark_queries, bm25_sql, embedding_sql, hybrid_sql, lexical_index, nearest_sql, rrf_sql, table, tokens_sql


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def token_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" altered"))).otherwise(F.col("text")))
    previous = before.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_hash"), tokenize("text").alias("tokens"))
    out = lexical.reuse_tokens(docs, previous, "doc_id")
    return out.select(F.col("id").alias("doc_id"), "document_hash", "reused", F.size("tokens").cast("long").alias("n_tokens"))


def _first_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_queries(spark, sf_dir).filter("query_id = 0")


def _ranked(df: DataFrame, value: str = "score") -> DataFrame:
    return df.select("query_id", F.col("id").alias("doc_id"), F.round(value, 6).alias(value), F.col("rank").cast("long").alias("rank"))


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(lexical.bm25_top(lexical_index(spark, sf_dir), _first_query(spark, sf_dir), 10))


def bm25_batch_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(lexical.bm25_top(lexical_index(spark, sf_dir), benchmark_queries(spark, sf_dir), 10))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    query = vectors.filter("id = 0").first()["embedding"]
    return vector.nearest_one(vectors, query, 20).select(F.col("id").alias("vec_id"), F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vector.nearest(vectors, asked, 10).select("query_id", F.col("id").alias("vec_id"), F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


def vector_lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 10 nearest of every vector whose id is divisible by 20, through inverted lists of all vectors."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = ann.nearest_in_lists(ann.build_lists(vectors, 10), asked, 10)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


def vector_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding")).alias("dimension"), (F.min(F.size("embedding")) == F.max(F.size("embedding"))).alias("uniform"))


def hash_embed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.hash_counts(table(spark, sf_dir, "documents"), "doc_id").select(F.col("id").alias("doc_id"), "bucket", "n")


def hybrid(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int = 70, anchors: DataFrame | None = None) -> DataFrame:
    model = vector.HashingEmbedder()
    vectors = vector.embed(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")), model).select("id", "embedding")
    semantic = vector.nearest(vectors, vector.embed(queries, model, "query"), k)
    return fusion.reciprocal_ranks(semantic, lexical.bm25_top(lexical_index(spark, sf_dir), queries, k), anchors=anchors)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(hybrid(spark, sf_dir, benchmark_queries(spark, sf_dir)))


def rrf_anchor_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("id"))
    return _ranked(hybrid(spark, sf_dir, benchmark_queries(spark, sf_dir), anchors=first))


def _sub_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = F.transform(F.array(F.substring_index("text", ".", 1), F.expr("substring(text, length(substring_index(text, '.', 1)) + 2)")), lambda x: F.trim(x))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("parent_id"), F.posexplode(halves).alias("part", "query")).filter("query <> ''")
    return q.select((F.col("parent_id") * 2 + F.col("part")).alias("query_id"), "parent_id", "query")


def subquery_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _sub_queries(spark, sf_dir)
    merged = fusion.merge_sub_queries(hybrid(spark, sf_dir, q.select("query_id", "query"), 20), q.select("query_id", "parent_id"))
    return _ranked(merged)


def dynamic_top_k_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dynamic_top_k(hybrid(spark, sf_dir, benchmark_queries(spark, sf_dir)), 12, 70)


def dynamic_top_k_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dynamic_top_k(hybrid(spark, sf_dir, benchmark_queries(spark, sf_dir), 20), 3, 20)


def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = benchmark_queries(spark, sf_dir)
    return fusion.refusals(q, hybrid(spark, sf_dir, q, 20), 0.064)


def should_decompose_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    return b.unionByName(c).select("id", should_decompose("text").alias("decompose"))


QUERIES = {f.__name__: f for f in (tokenize_docs, term_stats, token_reuse, bm25_top10, bm25_batch_top10, vector_top20, vector_batch_topk, vector_lists_topk, vector_dimension, hash_embed_docs, rrf_hybrid, rrf_anchor_boost, subquery_max_merge, dynamic_top_k_std, dynamic_top_k_stream, refusal_flag)} | {"should_decompose": should_decompose_texts}

_OUT = "SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM {0}"


def _dynamic(low: int, high: int, k: int) -> str:
    return f"""WITH {hybrid_sql(k)},
gaps AS (SELECT query_id, rank - 1 AS spot, lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score AS gap FROM rrf),
n AS (SELECT query_id, count(*) AS n FROM gaps GROUP BY 1),
drops AS (SELECT query_id, spot, row_number() OVER (PARTITION BY query_id ORDER BY gap DESC, spot) AS o FROM gaps WHERE gap > 0 AND spot >= {low} AND spot < {high})
SELECT query_id, (CASE WHEN n <= {low} THEN n ELSE least(n, coalesce(spot, {high})) END)::INT AS k FROM n LEFT JOIN drops USING (query_id) WHERE coalesce(o, 1) = 1"""


_SUBS = """subs AS (SELECT item_id * 2 + part AS query_id, item_id AS parent_id, query FROM (
  SELECT item_id, 0 AS part, trim(split_part(text, '.', 1)) AS query FROM benchmark
  UNION ALL SELECT item_id, 1, trim(substring(text, length(split_part(text, '.', 1)) + 2)) FROM benchmark) WHERE query <> '')"""

ORACLES = {
    "tokenize_docs": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "term_stats": f"WITH {INDEX_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "token_reuse": f"SELECT doc_id, sha256(coalesce(text, '')) AS document_hash, doc_id % 2 <> 0 AS reused, len({tokens_sql('text')}) AS n_tokens FROM documents",
    "bm25_top10": f"WITH {INDEX_SQL}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id = 0), {bm25_sql('q', 10)} {_OUT.format('lex')}",
    "bm25_batch_top10": f"WITH {INDEX_SQL}, {BENCH_SQL}, {bm25_sql('bench', 10)} {_OUT.format('lex')}",
    "vector_top20": f"WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings), q AS (SELECT * FROM v WHERE id = 0), {nearest_sql('v', 'q', 20)} SELECT id AS vec_id, round(dist, 6) + 0 AS dist, rank FROM sem",
    "vector_batch_topk": f"WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS embedding FROM embeddings), q AS (SELECT * FROM v WHERE id % 20 = 0), {nearest_sql('v', 'q', 10)} SELECT query_id, id AS vec_id, round(dist, 6) + 0 AS dist, rank FROM sem",
    "vector_dimension": "SELECT max(len(embedding))::INT AS dimension, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings",
    "hash_embed_docs": f"WITH {embedding_sql('documents', 'doc_id', 'text', 'v')} SELECT id AS doc_id, b AS bucket, n FROM v_c",
    "rrf_hybrid": f"WITH {hybrid_sql()} {_OUT.format('rrf')}",
    "rrf_anchor_boost": f"WITH first AS (SELECT min(doc_id) AS id FROM documents GROUP BY source), {hybrid_sql(anchors='first')} {_OUT.format('rrf')}",
    "subquery_max_merge": f"""WITH {INDEX_SQL}, {_SUBS}, {bm25_sql('subs', 20)}, {embedding_sql('documents', 'doc_id', 'text', 'dvec')}, {embedding_sql('subs', 'query_id', 'query', 'qvec')},
{nearest_sql('dvec', 'qvec', 20)}, {rrf_sql('sem', 'lex')},
best AS (SELECT parent_id AS query_id, id, max(score) AS score FROM rrf JOIN subs USING (query_id) GROUP BY ALL)
SELECT query_id, id AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best""",
    "dynamic_top_k_std": _dynamic(12, 70, 70),
    "dynamic_top_k_stream": _dynamic(3, 20, 20),
    "refusal_flag": f"WITH {hybrid_sql(20)} SELECT query_id, coalesce(max(score) < 0.064, true) AS refused FROM bench LEFT JOIN rrf USING (query_id) GROUP BY query_id",
    "should_decompose": r"""WITH t AS (SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
s AS (SELECT id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM t)
SELECT id, length(s) > 4 AND (len(regexp_split_to_array(s, '\s+')) > 1 OR regexp_matches(s, '[\x{4e00}-\x{9fff}]')) AS decompose FROM s""",
}
