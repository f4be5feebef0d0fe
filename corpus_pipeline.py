"""From raw ``documents`` to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import jaccard_join, packing, quality_classifier, suffix_dedup, toxicity
from skeinwork.llm.shared import materialise, table, unused

TOXIC_AT, GOOD_AT = 0.3, 0.5
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows under the score. Null and empty texts have the score of no words and stay; repeated rows fare alike; no rows give none."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, model, keep=tuple(docs.columns)).filter(F.col(unused(docs.columns, "score")) < TOXIC_AT).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the score or more. Null and empty texts have the score of no features; repeated rows fare alike; no rows give none."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, keep=tuple(docs.columns)).filter(F.col(unused(docs.columns, "score")) >= GOOD_AT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group. Null and empty texts and rows without doc_id are in no group and stay; of repeated rows one stays."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the repeated bytes of their texts. Null texts stay null; repeated rows are the same document again."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece. Null and empty texts give one piece with the end alone; repeated rows are separate items; no rows give none."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: SQL can express neither the models nor the tokenizer; a test holds each stage's ids and texts against plain Python (the
#: stages of the models against the trained model on one text at a time).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
