"""Splitting of texts into overlapping chunks, and anchor chunks of paged documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Chunking, EngineConfig
from ..functions.text import split_lines, strip

#: Characters of chunks that a task holds before it sends them on.
HELD_CHARS = 1 << 20


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of a text; each but the first begins with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces of at most ``size`` characters; the next run repeats up to ``overlap`` of the last one's end."""
    window: deque[str] = deque()
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while held > overlap or (held and held + len(piece) > size):
                held -= len(window.popleft())
        window.append(piece)
        held += len(piece)
    yield "".join(window)


def split_text(text: str | None, how: Chunking) -> list[str]:
    """Chunks of at most how.size characters, cut at the coarsest separator that serves; stripped, none empty."""
    out: list[str] = []

    def keep(pieces: list[str]) -> None:
        out.extend(s for s in (c.strip() for c in _packed(pieces, how.size, how.overlap)) if s)

    def cut(part: str, separators: tuple[str, ...]) -> None:
        at = next((i for i, s in enumerate(separators) if not s or s in part), len(separators) - 1)
        finer, short = separators[at + 1 :], []
        for piece in _pieces(part, separators[at]):
            if len(piece) < how.size:
                short.append(piece)
                continue
            keep(short)
            short = []
            if finer:
                cut(piece, finer)
            elif piece.strip():
                out.append(piece.strip())
        keep(short)

    if text:
        cut(text, how.separators)
    return out


def split_rows(df: DataFrame, how: Chunking, keep: Iterable[str], text: str = "text") -> DataFrame:
    """``keep`` columns, at (from 0) and chunk: a row for each chunk of each row's text.

    A task holds the chunks of one text and HELD_CHARS characters of those that it sends on, however many rows a batch has.
    """
    keep = list(keep)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("at", T.IntegerType(), False), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, chunks, held = [], [], [], 0

            def sent() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in b.columns[:-1]), pa.array(at, pa.int32()), pa.array(chunks, pa.string())], names=schema.names)  # noqa: B023

            for i, value in enumerate(b.column(b.num_columns - 1)):
                for k, chunk in enumerate(split_text(value.as_py(), how)):
                    row.append(i)
                    at.append(k)
                    chunks.append(chunk)
                    held += len(chunk)
                    if held >= HELD_CHARS:
                        yield sent()
                        row, at, chunks, held = [], [], [], 0
            if row:
                yield sent()

    return df.select(*keep, F.col(text).alias(unused(keep))).mapInArrow(run, schema)


def unused(columns: list[str]) -> str:
    """A name that no column has."""
    return "text" + "_" * max((len(c) for c in columns), default=0)


def chunk_pages(pages: DataFrame, config: EngineConfig) -> DataFrame:
    """Chunks of (source columns, page, text) rows: one row a page, or one with null page for unpaged documents.

    chunk_index runs over all pages of a source. Paged documents also get an anchor chunk of the first lines of their first
    page that has text, with that page's whole text beside it.
    """
    parts = None
    for kind, how in config.chunking.items():
        mine = pages.filter(F.col("file_type") == kind) if kind in ("pdf", "text") else pages.filter(~F.col("file_type").isin("pdf", "text"))
        some = split_rows(mine, how, [c for c in pages.columns if c != "text"])
        parts = some if parts is None else parts.unionByName(some)
    index = F.row_number().over(Window.partitionBy("source_id").orderBy(F.asc_nulls_first("page"), "at")) - 1
    source = [c for c in pages.columns if c not in ("page", "text")]
    chunks = parts.withColumn("chunk_index", index).select(
        *source, F.concat("source_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "page",
        F.lit(None).cast("string").alias("chunk_type"), F.col("chunk").alias("text"), F.lit(None).cast("string").alias("page_text"),
    )
    return chunks.unionByName(anchors(pages))


def anchor_text(text, lines: int = 5):
    """The first lines of a text, trimmed, without empty ones, in one."""
    return F.array_join(F.filter(F.transform(F.slice(split_lines(text), 1, lines), strip), lambda x: x != ""), " ")


def anchors(pages: DataFrame) -> DataFrame:
    """The anchor chunk of each paged document whose first page with text has any in its first lines."""
    source = [c for c in pages.columns if c not in ("page", "text")]
    paged = pages.filter(F.col("page").isNotNull() & (strip("text") != ""))
    first = paged.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("page"))).filter("n = 1")
    out = first.select(
        *source, F.concat("source_id", F.lit("_anchor")).alias("chunk_id"), F.lit(-1).alias("chunk_index"), F.lit(1).alias("page"),
        F.lit("anchor").alias("chunk_type"), anchor_text("text").alias("anchor"), F.col("text").alias("page_text"),
    )
    return out.filter("anchor <> ''").withColumnRenamed("anchor", "text").select(*source, "chunk_id", "chunk_index", "page", "chunk_type", "text", "page_text")
