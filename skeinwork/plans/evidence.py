"""Queries from ranked chunks to citations, contexts and messages, and over retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PASSAGE, cited, entities, mask_key, parse_entity_response, parse_sub_queries, split_paths, unknown_citations
from ..operators import chunking, evidence, lexical, quality
from ..operators.chunking import anchor_text
from ..config import EngineConfig
from .parts import BENCH_SQL, INDEX_SQL, benchmark_queries, bm25_sql, entities_sql, lexical_index, table

CONTEXT_CHARS = 4000
GATES = {"recall": 0.9, "mrr": 0.2, "ndcg": 0.95}


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five documents of each source stand for ranked chunks; two sources share each display name."""
    docs = table(spark, sf_dir, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select(
        F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("source_id"), F.concat(F.lit("/data/"), "source").alias("source_path"),
        F.concat(F.lit("name"), F.length("source").cast("string")).alias("source_name"), F.col("source"), (F.col("doc_id") % 7).cast("int").alias("chunk_index"),
        F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 11).cast("int")).alias("page"), F.col("text"), rank.alias("rank"),
    )


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evidence.citations(_ranked(spark, sf_dir).filter("rank <= 5"))
    return out.select("query_id", "citation_id", "chunk_id", "source_name", "page", "chunk_index", "snippet")


def citation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = evidence.citations(_ranked(spark, sf_dir).filter("rank <= 5")).select("query_id", "citation_id", "chunk_id", "chunk_index")
    return evidence.citation_payload(records)


def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.ambiguous_names(_ranked(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    return evidence.labelled(rows.filter("rank <= 5"), rows)


def format_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.format_sources(_labelled(spark, sf_dir))


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.build_context(_labelled(spark, sf_dir), CONTEXT_CHARS)


def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("As [S1] and S2 say, S"), (F.col("doc_id") % 9).cast("string"), F.lit(" too; xS3 S4x. "), "text").alias("answer"))
    valid = F.array(*[F.lit(f"S{i}") for i in range(1, 6)])
    return answers.select("doc_id", F.array_join(F.sort_array(cited("answer")), ",").alias("cited"), F.array_join(F.sort_array(unknown_citations("answer", valid)), ",").alias("unknown"))


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text verbatim."""
    return quality.holders(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), benchmark_queries(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = benchmark_queries(spark, sf_dir)
    top = lexical.bm25_top(lexical_index(spark, sf_dir), q, 10).select("query_id", "id", "rank")
    return quality.per_query(q, top, _relevant(spark, sf_dir), 10)


def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


def quality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.means(_scores(spark, sf_dir)).select("queries", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failed_gates(quality_means(spark, sf_dir), GATES | {"absent": 0.5})


def history_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.col("back").cast("long").alias("back"))


def llm_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    prompts = turns.groupBy("conv_id").agg(F.concat(F.lit("Question "), F.count("*").cast("string")).alias("prompt"))
    out = evidence.messages(turns, prompts, "Answer from the documents.")
    return out.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n"), 256).alias("digest"))


def enriched_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.col("doc_id") % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(anchor, "anchor").alias("chunk_type"), F.when(anchor, anchor_text("text")).otherwise(F.col("text")).alias("text"), F.col("text").alias("page_text"))
    return evidence.enrich(docs).select("doc_id", F.length("text").cast("long").alias("n"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    how = EngineConfig().chunking["text"]
    docs = chunking.split_rows(table(spark, sf_dir, "documents"), how, ["doc_id"])
    return docs.select("doc_id", F.col("at").alias("chunk_index"), F.length("chunk").alias("n_chars"), F.col("chunk").alias("text"))


def anchor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", anchor_text("text").alias("anchor"))


def path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" /a/"), F.col("doc_id").cast("string"), F.lit(" ,, b，"), F.col("source"), F.lit(" ，"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_paths(raw)).alias("pos", "path"))


def masked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mask_key(F.substring("c_name", 1, (F.col("c_custkey") % 14).cast("int"))).alias("shown"))


def sub_query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", "text")
    reply = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```json\n"), F.to_json(F.array(F.lit("one"), F.col("item_id").cast("string"))), F.lit("\n```"))).when(F.col("item_id") % 3 == 1, F.lit("[]")).otherwise(F.lit("no list"))
    return q.select("item_id", F.posexplode(parse_sub_queries(reply, "text")).alias("pos", "query"))


def entity_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of whole documents' lines: two passages, a heading with nothing under it, and one to three wanted."""
    docs = table(spark, sf_dir, "documents")
    answer = F.concat(F.lit(f"  {PASSAGE}1---\n- "), F.coalesce("text", F.lit("")), F.lit(f"\n{PASSAGE}2---\n \n{PASSAGE}3---\n*  "), "lang", F.lit("\n·· "), "source", F.lit("\n"))
    parsed = docs.select("doc_id", F.posexplode(parse_entity_response(answer, (F.col("doc_id") % 3 + 1).cast("int"))).alias("passage", "found"))
    return parsed.select("doc_id", "passage", F.size("found").cast("long").alias("n"), F.md5(F.array_join("found", "|")).alias("digest"))


def entity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(entities("text"), " ").alias("entities"))


QUERIES = {f.__name__: f for f in (citations, citation_payload, ambiguous_names, format_sources, context_blocks, citation_validation, recall_mrr_ndcg, quality_means, quality_gates, history_last5, llm_messages, enriched_anchors, chunk_documents, path_parse, masked_keys, sub_query_parse, entity_response_parse, entity_lists)} | {"anchor_text": anchor_texts}

_RANKED = """ranked AS (SELECT source AS query_id, doc_id::VARCHAR AS chunk_id, source AS source_id, '/data/' || source AS source_path, 'name' || length(source) AS source_name,
  (doc_id % 7)::INT AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 11)::INT END AS page, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
amb AS (SELECT source_name AS name, count(DISTINCT source_id) AS identities FROM ranked GROUP BY 1 HAVING count(DISTINCT source_id) > 1),
labelled AS (SELECT r.*, CASE WHEN a.name IS NOT NULL THEN source_path ELSE source_name END AS label, substring(replace(coalesce(text, ''), chr(10), ' '), 1, 150) AS snippet FROM ranked r LEFT JOIN amb a ON a.name = source_name WHERE rank <= 5)"""

_QUALITY = f"""{INDEX_SQL}, {BENCH_SQL}, {bm25_sql("bench", 10)},
rel AS (SELECT DISTINCT query_id, doc_id AS id FROM bench JOIN documents ON contains(text, query)),
hit AS (SELECT query_id, lex.rank FROM lex JOIN rel USING (query_id, id)),
agg AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM hit GROUP BY 1),
nrel AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
scores AS (SELECT query_id, CASE WHEN n IS NULL THEN 1 ELSE coalesce(found / n, 0) END::DOUBLE AS recall, CASE WHEN n IS NULL THEN 1 ELSE coalesce(1 / first, 0) END::DOUBLE AS reciprocal_rank,
  CASE WHEN n IS NULL THEN 1 ELSE coalesce(gain / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 0) END::DOUBLE AS ndcg
  FROM bench LEFT JOIN nrel USING (query_id) LEFT JOIN agg USING (query_id)),
means AS (SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM scores)"""

_W = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"

ORACLES = {
    "citations": f"WITH {_RANKED} SELECT query_id, 'S' || rank AS citation_id, chunk_id, source_name, page, chunk_index, snippet FROM labelled",
    "citation_payload": f"""WITH {_RANKED} SELECT query_id, 'S' || rank AS citation_id, '{{"citation_id":"S' || rank || '","chunk_id":"' || chunk_id || '","chunk_index":' || chunk_index || '}}' AS payload FROM labelled""",
    "ambiguous_names": f"WITH {_RANKED} SELECT * FROM amb",
    "format_sources": f"""WITH {_RANKED} SELECT query_id, string_agg('[S' || rank || '] ' || label || ' (' || CASE WHEN page IS NULL THEN '' ELSE 'p.' || page || ', ' END || 'chunk ' || chunk_index || '; chunk_id=' || chunk_id || '): ' || snippet || '...', chr(10) ORDER BY rank) AS sources
FROM labelled GROUP BY 1""",
    "context_blocks": f"""WITH RECURSIVE {_RANKED},
framed AS (SELECT query_id, rank, '[Source: ' || label || '] [Citation: S' || rank || ']' || chr(10) || '<untrusted_document chunk_id="' || chunk_id || '">' || chr(10) AS head,
  replace(coalesce(text, ''), '</untrusted_document>', '</untrusted_document_text>') AS body FROM labelled),
walk AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, '' AS context, false AS stopped FROM framed
  UNION ALL SELECT query_id, rank, CASE WHEN stopped OR room < 0 THEN context ELSE context || CASE WHEN context = '' THEN '' ELSE chr(10) || chr(10) END || head
      || CASE WHEN length(body) <= room THEN body WHEN room >= 29 THEN rtrim(substring(body, 1, room - 29), chr(32) || chr(9) || chr(10) || chr(13)) || chr(10) || '[document context truncated]' ELSE substring(body, 1, room) END
      || chr(10) || '</untrusted_document>' END, stopped FROM (
    SELECT f.query_id, f.rank, f.head, f.body, w.context, w.stopped OR {CONTEXT_CHARS} - length(w.context) - CASE WHEN w.context = '' THEN 0 ELSE 2 END <= 0 AS stopped,
      {CONTEXT_CHARS} - length(w.context) - CASE WHEN w.context = '' THEN 0 ELSE 2 END - length(f.head) - 22 AS room FROM walk w JOIN framed f ON f.query_id = w.query_id AND f.rank = w.rank + 1))
SELECT query_id, arg_max(context, rank) AS context FROM walk GROUP BY 1""",
    "citation_validation": r"""WITH a AS (SELECT doc_id, 'As [S1] and S2 say, S' || doc_id % 9 || ' too; xS3 S4x. ' || text AS answer FROM documents),
c AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(answer, '\bS\d+\b'))) AS c FROM a)
SELECT doc_id, array_to_string(c, ',') AS cited, array_to_string(list_filter(c, lambda x: NOT list_contains(['S1', 'S2', 'S3', 'S4', 'S5'], x)), ',') AS unknown FROM c""",
    "recall_mrr_ndcg": f"WITH {_QUALITY} SELECT query_id, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM scores",
    "quality_means": f"WITH {_QUALITY} SELECT * FROM means",
    "quality_gates": f"""WITH {_QUALITY}, g AS (SELECT 'recall' AS metric, recall AS value, {GATES["recall"]}::DOUBLE AS minimum FROM means UNION ALL SELECT 'mrr', mrr, {GATES["mrr"]} FROM means
UNION ALL SELECT 'ndcg', ndcg, {GATES["ndcg"]} FROM means UNION ALL SELECT 'absent', 0, 0.5) SELECT * FROM g WHERE value < minimum""",
    "history_last5": "SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations) WHERE back <= 5",
    "llm_messages": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, count(*) + 2 AS n, sha256('system:Answer from the documents.' || chr(10) || string_agg(role || ':' || text, chr(10) ORDER BY turn) || chr(10) || 'user:Question ' || any_value(total)) AS digest FROM r WHERE back <= 5 GROUP BY 1""",
    "enriched_anchors": "SELECT doc_id, length(CASE WHEN doc_id % 5 = 0 THEN text ELSE text END) AS n FROM documents",
    "anchor_text": rf"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(l[1:5], lambda x: regexp_replace(x, '^{_W}+|{_W}+$', '', 'g')), lambda x: x <> ''), ' ') AS anchor FROM l""",
    "path_parse": """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(' /a/' || doc_id || ' ,, b，' || source || ' ，', '，', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, i::INT AS pos, p[i + 1] AS path FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM p)""",
    "masked_keys": """WITH k AS (SELECT c_custkey, substring(c_name, 1, c_custkey % 14) AS k FROM customer)
SELECT c_custkey, CASE WHEN k IS NULL OR k = '' THEN '<not set>' WHEN length(k) <= 8 THEN 'sk-...****' ELSE left(k, 3) || '...' || right(k, 4) END AS shown FROM k""",
    "sub_query_parse": """SELECT item_id, i::INT AS pos, q[i + 1] AS query FROM (SELECT item_id, q, unnest(range(len(q))) AS i FROM (
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN ['one', item_id::VARCHAR] ELSE [text] END AS q FROM benchmark))""",
    "entity_response_parse": rf"""WITH a AS (SELECT doc_id, (doc_id % 3 + 1)::INT AS n, '  {PASSAGE}1---' || chr(10) || '- ' || coalesce(text, '') || chr(10) || '{PASSAGE}2---' || chr(10) || ' ' || chr(10)
  || '{PASSAGE}3---' || chr(10) || '*  ' || lang || chr(10) || '·· ' || source || chr(10) AS answer FROM documents),
p AS (SELECT doc_id, n, regexp_split_to_array(answer, '(?:^|\n){_W}*{PASSAGE}[^\n]*') AS p FROM a),
l AS (SELECT doc_id, n, list_transform(p, lambda x: list_transform(list_filter(list_transform(string_split(x, chr(10)), lambda y: regexp_replace(y, '^{_W}+|{_W}+$', '', 'g')), lambda y: y <> ''), lambda y: regexp_replace(y, '^[-*· ]+', ''))) AS l FROM p),
f AS (SELECT doc_id, n, list_filter(l, lambda x: len(x) > 0) AS f FROM l),
e AS (SELECT doc_id, n, f, unnest(range(n)) AS k FROM f)
SELECT doc_id, k::INT AS passage, coalesce(len(f[k + 1]), 0) AS n, md5(coalesce(array_to_string(f[k + 1], '|'), '')) AS digest FROM e""",
    "entity_lists": f"WITH {entities_sql('documents', 'doc_id', 'text', 'ent')} SELECT doc_id, coalesce(string_agg(entity, ' ' ORDER BY k), '') AS entities FROM documents LEFT JOIN ent ON id = doc_id GROUP BY doc_id",
}
