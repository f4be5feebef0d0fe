"""Measures of queries; query texts are never kept."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import METRIC


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of measures; names that a row lacks are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in METRIC) for r in rows], METRIC)


def append(metrics: DataFrame, **values) -> DataFrame:
    """``metrics`` and one more row."""
    return metrics.unionByName(table(metrics.sparkSession, [values]))


def last(metrics: DataFrame, n: int = 100, order: str = "seq") -> DataFrame:
    """The n last rows."""
    return metrics.orderBy(F.desc(order)).limit(n)


def summary(metrics: DataFrame, n: int = 100) -> DataFrame:
    """One row over the last n: count, mean and last milliseconds, refusals, last error; zeros where there are none."""
    some = last(metrics, n)
    return some.agg(
        F.count("*").alias("count"),
        F.coalesce(F.round(F.avg("retrieval_ms"), 3), F.lit(0.0)).alias("avg_retrieval_ms"),
        F.coalesce(F.round(F.max_by("retrieval_ms", "seq"), 3), F.lit(0.0)).alias("last_retrieval_ms"),
        F.coalesce(F.sum(F.col("refused").cast("long")), F.lit(0)).alias("refusals"),
        F.max_by("error_category", F.when(F.col("error_category").isNotNull(), F.col("seq"))).alias("last_error"),
    )


def snapshot(metrics: DataFrame) -> DataFrame:
    return metrics.select("seq", F.to_json(F.struct(*metrics.columns)).alias("metric"))


def source_count(selected: DataFrame) -> DataFrame:
    """(query_id, sources): distinct sources of each selection."""
    return selected.groupBy("query_id").agg(F.count_distinct("source_id").alias("sources"))


def elapsed_ms(start: float, end: float | None = None) -> float:
    return max(0.0, ((time.perf_counter() if end is None else end) - start) * 1000)


def elapsed_text(seconds: float) -> str:
    minutes, rest = divmod(int(max(0, seconds)), 60)
    return f"{minutes}m {rest}s" if minutes else f"{rest}s"
