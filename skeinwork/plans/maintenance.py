"""Queries over index maintenance, guards, measures and file events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import clean_endpoint, endpoint_problem, or_else
from ..operators import index, metrics
from ..sources import files
from ..streaming import watch
from .parts import table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.concat(F.lit("/data/"), "source").alias("source_path"), F.col("doc_id").cast("string").alias("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"))


def _altered(chunks: DataFrame) -> DataFrame:
    """A newer copy in which every third source's first chunks changed."""
    third = F.substring("source_id", 4, 9).cast("int") % 3 == 0
    return chunks.filter(third).withColumn("content_sha256", F.sha2(F.concat("content_sha256", F.lit("x")), 256))


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    out = index.manifest(chunks.select("source_id", "source_path").distinct(), chunks)
    return out.select("source_id", "source_path", F.size("chunk_ids").cast("long").alias("n"), F.md5(F.array_join("chunk_ids", ",")).alias("digest"))


def index_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chunks_fingerprint(_chunks(spark, sf_dir))


def incremental_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _chunks(spark, sf_dir)
    new = _altered(old)
    return index.replace_sources(old, new, new.select("source_id", "source_path")).select("source_id", "chunk_id", "content_sha256")


def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _chunks(spark, sf_dir)
    new = _altered(old).unionByName(old.limit(0)).withColumn("chunk_id", F.when(F.col("chunk_id").cast("long") % 2 == 0, F.col("chunk_id")).otherwise(F.concat("chunk_id", F.lit("n"))))
    return index.upsert(old, new, "chunk_id").select("source_id", "chunk_id", "content_sha256")


def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([("src1", None), (None, "/data/src2"), ("absent", None)], "source_id string, source_path string")
    return index.without_sources(_chunks(spark, sf_dir), gone).select("source_id", "chunk_id")


def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _chunks(spark, sf_dir).groupBy("source_id", "source_path").agg(F.min("content_sha256").alias("content_sha256"))
    number = F.substring("source_id", 4, 9).cast("int")
    was = one.filter(number % 5 != 0).withColumn("content_sha256", F.when(number % 3 == 0, "old").otherwise(F.col("content_sha256")))
    return index.stale_sources(one, was)


def document_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id") % 10
    name = F.when(n == 0, ".env").when(n == 1, "a..b.txt").when(n == 2, "x.bin").when(n == 3, ".gitignore").when(n == 4, "R.PDF").otherwise("t.md")
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), name)
    return docs.select("doc_id", files.guard_reason(EngineConfig(max_document_bytes=5000), path, F.col("n_chars")).alias("reason"), files.file_type(path).alias("type"))


def endpoint_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 8
    url = F.when(n == 0, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).when(n == 1, F.lit("http://localhost:8080/v1/")).when(n == 2, F.lit("")).when(n == 3, F.lit("ftp://host/x")).when(n == 4, F.concat("url", F.lit("/"))).when(n == 5, F.lit("http://127.0.0.2/v1")).when(n == 6, F.lit("http://127.0.0.1:9/v1")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(endpoint_problem(url), F.lit("ok")).alias("policy"), clean_endpoint(url).alias("clean"))


def legacy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("doc_id") % 2 == 0, ""), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", or_else(a, b, F.lit("legacy")).alias("identity"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("value").alias("retrieval_ms"), (F.col("event_type") == "error").alias("refused"), F.when(F.col("event_id") % 50 == 7, F.col("event_type")).alias("error_category"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_metrics(spark, sf_dir))


def metrics_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last(_metrics(spark, sf_dir)).select("seq", F.round("retrieval_ms", 6).alias("retrieval_ms"))


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("source_id"))
    return metrics.source_count(docs)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("created", "modified", "moved", "deleted"))), (F.col("event_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("/w/"), F.when(F.col("user_id") % 6 == 0, F.lit(".")).otherwise(F.lit("f")), F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, F.lit(".bin")).otherwise(F.lit(".txt")))
    dest = F.when(kind == "moved", F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("/w/sub/d")).otherwise(F.lit("/w/d")), F.col("user_id").cast("string"), F.lit(".md")))
    return e.select(F.col("event_id").alias("seq"), "ts", kind.alias("kind"), name.alias("path"), dest.alias("dest"))


def file_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.actions(_events(spark, sf_dir), "/w").select("seq", F.col("part").cast("int").alias("part"), "path", "action")


def final_file_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.final_actions(watch.actions(_events(spark, sf_dir), "/w"))


def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _chunks(spark, sf_dir).groupBy("source_path", "source_id").agg(F.min("content_sha256").alias("content_sha256"))
    number = F.substring("source_id", 4, 9).cast("int")
    was = one.filter(number % 5 != 0).withColumn("content_sha256", F.when(number % 3 == 0, "old").otherwise(F.col("content_sha256")))
    return watch.listing_changes(one.filter(number % 7 != 0), was)


def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.debounce(table(spark, sf_dir, "events"), "user_id", 1800, "event_id").select("event_id", "user_id")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n")


def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return e.select("event_type", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n", "total")


QUERIES = {f.__name__: f for f in (source_manifest, index_fingerprint, incremental_replace, upsert_chunks, delete_source, stale_sources, document_guard, endpoint_policy, legacy_names, metrics_summary, metrics_last, source_counts, file_actions, final_file_actions, listing_changes, debounce_events, event_sessions, event_tumbling)}

_CHUNKS = "chunks AS (SELECT source AS source_id, '/data/' || source AS source_path, doc_id::VARCHAR AS chunk_id, sha256(coalesce(text, '')) AS content_sha256, substring(source, 4)::INT AS number FROM documents)"
_ONE = "one AS (SELECT source_id, source_path, number, min(content_sha256) AS content_sha256 FROM chunks GROUP BY ALL), was AS (SELECT source_id, source_path, CASE WHEN number % 3 = 0 THEN 'old' ELSE content_sha256 END AS content_sha256 FROM one WHERE number % 5 <> 0)"
_ACTIONS = """ev AS (SELECT event_id AS seq, ['created', 'modified', 'moved', 'deleted'][event_id % 4 + 1] AS kind, '/w/' || CASE WHEN user_id % 6 = 0 THEN '.' ELSE 'f' END || user_id || CASE WHEN user_id % 5 = 0 THEN '.bin' ELSE '.txt' END AS path,
  CASE WHEN event_id % 3 = 0 THEN '/w/sub/d' ELSE '/w/d' END || user_id || '.md' AS dest FROM events),
acts AS (SELECT * FROM (SELECT seq, 0 AS part, path, CASE WHEN kind IN ('deleted', 'moved') THEN 'delete' ELSE 'upsert' END AS action FROM ev
  UNION ALL SELECT seq, 1, dest, 'upsert' FROM ev WHERE kind = 'moved') WHERE regexp_matches(path, '^/w/[^/.~][^/]*[.](txt|md)$'))"""

ORACLES = {
    "source_manifest": f"WITH {_CHUNKS} SELECT source_id, source_path, count(*) AS n, md5(string_agg(chunk_id, ',' ORDER BY chunk_id)) AS digest FROM chunks GROUP BY ALL",
    "index_fingerprint": f"""WITH {_CHUNKS}, l AS (SELECT '{{"chunk_id": "' || chunk_id || '", "content_sha256": "' || content_sha256 || '"}}' AS l FROM chunks) SELECT sha256('[' || string_agg(l, ', ' ORDER BY l) || ']') AS fingerprint FROM l""",
    "incremental_replace": f"WITH {_CHUNKS} SELECT source_id, chunk_id, CASE WHEN number % 3 = 0 THEN sha256(content_sha256 || 'x') ELSE content_sha256 END AS content_sha256 FROM chunks",
    "upsert_chunks": f"""WITH {_CHUNKS}, new AS (SELECT source_id, CASE WHEN chunk_id::BIGINT % 2 = 0 THEN chunk_id ELSE chunk_id || 'n' END AS chunk_id, sha256(content_sha256 || 'x') AS content_sha256 FROM chunks WHERE number % 3 = 0)
SELECT source_id, chunk_id, content_sha256 FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT * FROM new""",
    "delete_source": f"WITH {_CHUNKS} SELECT source_id, chunk_id FROM chunks WHERE source_id <> 'src1' AND source_path <> '/data/src2'",
    "stale_sources": f"WITH {_CHUNKS}, {_ONE} SELECT * FROM (SELECT o.source_id, CASE WHEN w.source_id IS NULL THEN 'new' WHEN w.content_sha256 <> o.content_sha256 THEN 'changed' END AS state FROM one o LEFT JOIN was w USING (source_id)) WHERE state IS NOT NULL",
    "document_guard": """SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'path' WHEN doc_id % 10 = 0 THEN 'secret file' WHEN n_chars > 5000 THEN 'too large' WHEN doc_id % 10 IN (2, 3) THEN 'unsupported type' END AS reason,
CASE WHEN doc_id % 10 IN (0, 2, 3) THEN NULL WHEN doc_id % 10 = 4 THEN 'pdf' ELSE 'text' END AS type FROM documents""",
    "endpoint_policy": """WITH u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN 'http://localhost:8080/v1/' WHEN 2 THEN '' WHEN 3 THEN 'ftp://host/x' WHEN 4 THEN url || '/' WHEN 5 THEN 'http://127.0.0.2/v1' WHEN 6 THEN 'http://127.0.0.1:9/v1' ELSE url END AS u FROM pages),
p AS (SELECT page_id, u, CASE WHEN u = '' THEN 'empty' WHEN length(u) > 2048 THEN 'too long' WHEN NOT regexp_matches(u, '^https?://[^/]') THEN 'scheme' WHEN regexp_matches(u, '^https?://[^/@]*@') THEN 'credentials'
  WHEN u LIKE 'http://%' AND NOT regexp_matches(u, '^http://(localhost|127[.]0[.]0[.]1|\\[::1\\])([:/]|$)') THEN 'remote http' ELSE 'ok' END AS policy FROM u)
SELECT page_id, policy, CASE WHEN policy = 'ok' THEN rtrim(u, '/') END AS clean FROM p""",
    "legacy_names": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source <> '' THEN source ELSE 'legacy' END AS identity FROM documents",
    "metrics_summary": """WITH l AS (SELECT event_id AS seq, value, event_type, CASE WHEN event_id % 50 = 7 THEN event_type END AS err FROM events ORDER BY event_id DESC LIMIT 100)
SELECT count(*) AS count, coalesce(round(avg(value), 3), 0) AS avg_retrieval_ms, coalesce(round(arg_max(value, seq), 3), 0) AS last_retrieval_ms, coalesce(sum((event_type = 'error')::INT), 0)::BIGINT AS refusals, arg_max(err, seq) FILTER (err IS NOT NULL) AS last_error FROM l""",
    "metrics_last": "SELECT event_id AS seq, round(value, 6) AS retrieval_ms FROM events ORDER BY event_id DESC LIMIT 100",
    "source_counts": "SELECT lang AS query_id, count(DISTINCT source) AS sources FROM documents GROUP BY 1",
    "file_actions": f"WITH {_ACTIONS} SELECT * FROM acts",
    "final_file_actions": f"WITH {_ACTIONS} SELECT path, arg_max(action, seq * 2 + part) AS action FROM acts GROUP BY 1",
    "listing_changes": f"""WITH {_CHUNKS}, {_ONE}, now AS (SELECT * FROM one WHERE number % 7 <> 0)
SELECT * FROM (SELECT coalesce(n.source_path, w.source_path) AS path, CASE WHEN n.source_path IS NULL THEN 'delete' WHEN w.content_sha256 IS NULL OR n.content_sha256 <> w.content_sha256 THEN 'upsert' END AS kind FROM now n FULL JOIN was w ON n.source_path = w.source_path) WHERE kind IS NOT NULL""",
    "debounce_events": "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 30 MINUTE",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""",
    "event_tumbling": "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
}
