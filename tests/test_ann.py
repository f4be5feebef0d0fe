"""Approximate neighbours against exact ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.operators import ann, vector
from skeinwork.operators.store import scratch
from skeinwork.plans import retrieval


def exact(spark, sf_dir, k=10):
    v = retrieval._vectors(spark, sf_dir)
    return v, vector.nearest(v, v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), k)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_all_queries(spark, sf_dir):
    with scratch(spark):
        v, want = exact(spark, sf_dir)
        index = ann.build_lists(v, 10)
        assert index.rows.select("id").distinct().count() == index.rows.count() == v.count()  # every row is listed, once
        found = ann.nearest_in_lists(index, v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)
        row = ann.recall(found, want).first()
        assert row["queries"] == v.filter("id % 20 = 0").count() and row["recall"] >= 0.9
        assert found.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_all_lists_give_the_exact_answer(spark, sf):
    with scratch(spark):
        v, want = exact(spark, sf, 7)
        index = ann.build_lists(v, 7, lists=5, block=16)  # several blocks a list
        asked = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
        rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["dist"], 8)) for r in df.collect())
        assert rows(ann.nearest_in_lists(index, asked, 7, probes=5)) == rows(want)


def test_copies_zeros_nulls_and_nothing(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(60)] + [(100 + i, [r.gauss(0, 1) for _ in range(3)]) for i in range(40)] + [(200, [0.0, 0.0, 0.0]), (201, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = v.filter("id IN (0, 59, 100, 200, 201)").select(F.col("id").alias("query_id"), "embedding")
    with scratch(spark):
        index = ann.build_lists(v, 4, lists=6, block=8)
        assert index.rows.count() == 101 and index.blocks.agg(F.max("blocks")).first()[0] >= 8  # copies are one list in many blocks
        found = {(r["query_id"], r["rank"]): r["id"] for r in ann.nearest_in_lists(index, asked, 4).collect()}
        assert [found[59, k] for k in range(1, 5)] == [0, 1, 2, 3] and found[100, 1] == 100 and (201, 1) not in found and (200, 1) in found
        index.save(str(tmp_path / "lists"))
        again = ann.Lists.load(spark, str(tmp_path / "lists"))
        assert again.probes == index.probes and np.allclose(again.centroids, index.centroids)
        assert {(r["query_id"], r["rank"]): r["id"] for r in ann.nearest_in_lists(again, asked, 4).collect()} == found
        none = ann.build_lists(v.limit(0), 4)
        assert none.rows.count() == 0 and ann.nearest_in_lists(none, asked, 4).count() == 0
        assert ann.nearest_in_lists(index, asked.limit(0), 4).count() == 0
