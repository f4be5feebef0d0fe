"""One query for each operator, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard_join, line_quality, media, packing, prefix_trie, quality_classifier, sentence_pieces, suffix_dedup, token_counts, toxicity, whitening
from .shared import table

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality.line_quality(docs, line_quality.train(docs, table(spark, sf_dir, "labels")))


def op4_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.example_digests(chat.prefix_target_examples(rows.unionByName(more)))


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, ids_sha256 (of the decimal ids with commas between), text_sha256 and same of every whole text.

    ``text_sha256`` is of the text decoded from the ids, and ``same`` whether that is the text that was encoded (null as empty).
    """
    path = public_tokenizers.path(PIECE_BPE)
    docs = table(spark, sf_dir, "documents").withColumn("given", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = sentence_pieces.round_trip(docs, path, ("doc_id", "given"))
    decoded = F.sha2("text", 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), decoded.alias("text_sha256"), (decoded == F.col("given")).alias("same"))


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op9_media_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), borrow=(5, 9))


QUERIES = {
    "op1_pack_documents": op1_pack_documents,
    "op2_token_counts": op2_token_counts,
    "op3_line_quality": op3_line_quality,
    "op4_chat_examples": op4_chat_examples,
    "op5_quality_scores": op5_quality_scores,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_toxic_spans": op7_toxic_spans,
    "op8_jaccard_groups": op8_jaccard_groups,
    "op9_media_round_trip": op9_media_round_trip,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_decontaminate": op11_decontaminate,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Formatted length of a turn: "### " role ":\n" text "\n</turn>\n", where \ # < (and : in roles) take one more character.
_TURN = (
    "15 + 2 * length(role) - length(regexp_replace(role, '[\\\\#<:]', '', 'g'))"
    " + 2 * length(text) - length(regexp_replace(text, '[\\\\#<]', '', 'g'))"
)

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 of a number's decimal text, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),"
    " lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
)

ORACLES = {
    "op13_prefix_trie": f"""
WITH own AS MATERIALIZED (
  SELECT conv_id, list(sha256(coalesce(role, '')) || coalesce(text, '') ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t,
    list(strlen(coalesce(text, ''))::BIGINT ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), ways AS (SELECT *, ({_CRC}) % 9 AS h FROM own),
whole AS MATERIALIZED (
  SELECT w.conv_id, list_concat(coalesce(b.t[1 : h], []), w.t[h + 1 :]) AS t, list_concat(coalesce(b.n[1 : h], []), w.n[h + 1 :]) AS n
  FROM ways w LEFT JOIN own b ON b.conv_id = w.conv_id - w.conv_id % 5
), paths AS MATERIALIZED (
  SELECT conv_id, d AS depth, sha256(array_to_string(list_transform(t[1 : d], lambda x: sha256(x)), '')) AS node,
    sha256(array_to_string(list_transform(t[1 : d - 1], lambda x: sha256(x)), '')) AS up, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS bytes, d = len(t) AS ends
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM whole)
), nodes AS MATERIALIZED (
  SELECT node, depth, min(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY node, depth
), children AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node, depth)),
sums AS (
  SELECT p.node, p.depth, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
  FROM told n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM told n JOIN sums USING (node, depth) LEFT JOIN nodes u ON u.node = n.up AND u.depth = n.depth - 1
""",
    "op11_decontaminate": f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
asked AS (SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS phrase, len(w[i : i + 9]) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
placed AS (SELECT row, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
  FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM docs) CROSS JOIN (SELECT DISTINCT n FROM asked) WHERE i + n - 1 <= len(w)),
hits AS MATERIALIZED (SELECT row, i, n, item FROM placed JOIN asked USING (phrase, n)),
words AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM hits) GROUP BY row),
found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (row) LEFT JOIN found USING (row)
""",
    "op4_chat_examples": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), laid AS (
  SELECT *, row_number() OVER w AS k, {_TURN} AS n, role = 'assistant' AS reply FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, k = max(k) OVER (PARTITION BY conv_id) AS last FROM laid
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (reply), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (reply), '')) AS loss_sha256,
  (sum(upto) FILTER (reply OR last))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
""",
}
