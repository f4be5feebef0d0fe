"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], held_out: tuple[int, int] | None) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, text, label) of at most ``most[c]`` rows of each class c, and how many of each class there are.

    ``held_out`` = (n, r) leaves out rows whose crc32(doc_id as text) mod n is r. Which rows are taken depends on a hash of
    doc_id alone. Null labels and ids are left out; of several labels for one id the largest counts. The sampled ids are at
    most sum(most), so they are broadcast.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        usable = usable.filter(crc_mod("doc_id", held_out[0]) != held_out[1])
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    there = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    picked = [usable.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[c]) for c in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), (there.get(0, 0), there.get(1, 0))
