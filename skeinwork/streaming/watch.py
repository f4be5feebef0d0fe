"""Changes of a watched directory as events, and their effect on the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import file_type

UPSERT, DELETE = "upsert", "delete"


def ignored(path: str = "path"):
    """Hidden and temporary files, thumbnails, and types that aren't supported."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return name.rlike(r"^[.~]") | (name == "Thumbs.db") | file_type(path).isNull()


def listing_changes(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, kind): files (source_path, content_sha256) that are new or changed, and indexed ones that are gone.

    A file source of a stream neither repeats a changed path nor reports a removed one, so listings are compared.
    """
    was = indexed.select(F.col("source_path").alias("path"), F.col("content_sha256").alias("old"))
    now = files.select(F.col("source_path").alias("path"), F.col("content_sha256").alias("new"))
    kind = F.when(F.col("new").isNull(), DELETE).when(~F.col("new").eqNullSafe(F.col("old")), UPSERT)
    return now.join(was, "path", "full_outer").select("path", kind.alias("kind")).filter("kind IS NOT NULL")


def actions(events: DataFrame, directory: str | None = None) -> DataFrame:
    """(seq, ts, path, action) from (seq, ts, kind, path, dest): a move removes its origin and adds its destination.

    Only paths directly in ``directory`` count, where one is given; ignored files never do.
    """
    here = (lambda c: F.regexp_replace(c, r"/[^/]+$", "") == directory.rstrip("/")) if directory else (lambda c: c.isNotNull())
    kind = F.col("kind")
    rows = F.array(
        F.when(kind.isin("deleted", "moved"), F.struct(F.col("path").alias("path"), F.lit(DELETE).alias("action"))).when(kind.isin("created", "modified"), F.struct(F.col("path").alias("path"), F.lit(UPSERT).alias("action"))),
        F.when((kind == "moved") & F.col("dest").isNotNull(), F.struct(F.col("dest").alias("path"), F.lit(UPSERT).alias("action"))),
    )
    marks = [c for c in ("size", "mtime_ns") if c in events.columns]
    out = events.select("seq", "ts", *marks, F.posexplode(rows).alias("part", "x")).filter("x IS NOT NULL").select("seq", "part", "ts", "x.path", "x.action", *marks)
    return out.filter(here(F.col("path")) & ~ignored("path"))


def debounce(events: DataFrame, key: str, seconds: float, order: str = "seq") -> DataFrame:
    """The events that no other of the same key follows within ``seconds``."""
    following = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", order))
    return events.withColumn("__next", following).filter(F.col("__next").isNull() | (F.unix_micros(F.col("__next").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) >= int(seconds * 1e6))).drop("__next")


def final_actions(events: DataFrame) -> DataFrame:
    """The last action of each path."""
    return events.groupBy("path").agg(F.max_by("action", F.struct("seq", "part")).alias("action"))


def debounced_stream(events: DataFrame, seconds: float = 2, late: str = "10 seconds") -> DataFrame:
    """Streaming form: bursts of a path as session windows, with the last action of each."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy("path", F.session_window("ts", f"{seconds} seconds").alias("burst")).agg(F.max_by("action", "ts").alias("action"), F.count("*").alias("events"))


def watch(spark: SparkSession, trigger_rows: DataFrame, changes: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], on_error: Callable[[int, Exception], None], checkpoint: str) -> StreamingQuery:
    """Compares listings at each micro-batch of ``trigger_rows`` and applies what changed; batches run one after the other.

    An error is handed to ``on_error`` and the next batch tries again, as the comparison is with what was published.
    """

    def batch(_: DataFrame, number: int) -> None:
        try:
            found = changes()
            if found.limit(1).count():
                apply(found, number)
        except Exception as e:  # noqa: BLE001
            on_error(number, e)

    return trigger_rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
