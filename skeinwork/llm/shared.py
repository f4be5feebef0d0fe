"""Where the operators keep what several executors or later steps read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session may do without one and gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skeinwork-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts the lineage, and any executor can read it."""
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a path below the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=pa.schema([schema.field(k) for k in columns]))


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of an integer column's decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from ``columns`` (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(df: DataFrame, keep: tuple[str, ...], text: str = "text") -> tuple[DataFrame, int]:
    """``keep`` columns first, then the text column unless it is among them; and the text's place."""
    if text in keep:
        return df.select(*keep), list(keep).index(text)
    return df.select(*keep, text), len(keep)
