"""Files as tables: listing, guards, and text of plain, paged and word-processor documents."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TEXT_EXTENSIONS, EngineConfig
from ..functions.text import split_paths, valid_text
from ..operators.store import written
from ..schemas import PAGES, SOURCES

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SUPPORTED = (*TEXT_EXTENSIONS, ".pdf", ".docx")
REASON = "reason"


def file_type(path: Column | str) -> Column:
    """pdf, docx, text, or null where the extension isn't supported."""
    ext = F.lower(F.regexp_extract(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]+)$", 1), r"^\.*[^.].*(\.[^.]+)$", 1))
    return F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").when(ext.isin(*TEXT_EXTENSIONS), "text")


def canonical_path(path: str) -> str:
    return os.path.realpath(os.path.abspath(os.path.expanduser(path)))


def source_id(path: str) -> str:
    return hashlib.sha256(os.path.normcase(canonical_path(path)).encode()).hexdigest()


def collection_name(paths: list[str]) -> str:
    """The name of the collection of some files, whatever their order."""
    return "rag_" + hashlib.md5("|".join(sorted(canonical_path(p) for p in paths)).encode()).hexdigest()[:8]


def parse_paths(text: str | None) -> list[str]:
    """Paths between commas of either width."""
    return [p for p in (x.strip() for x in re.split("[,，]", text or "")) if p]


def paths_column(text: Column | str) -> Column:
    return split_paths(text)


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Supported files directly in a directory, by path."""
    files = spark.read.format("binaryFile").load(directory).drop("content")
    return files.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).filter(file_type("path").isNotNull()).orderBy("path")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Source columns and content of the files that exist, each once; Spark never reads hidden files, such as .env."""
    known = sorted({canonical_path(p) for p in paths})
    there = [p for p in known if os.path.isfile(p)]
    if not there:
        return spark.createDataFrame([], "source_id string, source_path string, source_name string, source string, file_type string, content_sha256 string, source_size long, source_mtime_ns long, content binary")
    raw = spark.read.format("binaryFile").load(there)
    return as_sources(raw)


def as_sources(raw: DataFrame) -> DataFrame:
    """Source columns and content from (path, modificationTime, length, content)."""
    path = F.regexp_replace("path", "^file:/*", "/")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return raw.select(
        F.sha2(path, 256).alias("source_id"), path.alias("source_path"), name.alias("source_name"), name.alias("source"), file_type(path).alias("file_type"),
        F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("source_size"), (F.unix_micros("modificationTime") * 1000).alias("source_mtime_ns"), "content",
    )


def guard_reason(config: EngineConfig, path: Column, size: Column) -> Column:
    """Why a document may not be read, or null."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    reason = F.when(path.contains(".."), "path").when(name == ".env", "secret file").when(size > config.max_document_bytes, "too large").when(file_type(path).isNull(), "unsupported type")
    if config.document_root:
        root = canonical_path(config.document_root).rstrip("/") + "/"
        return reason.when(~path.startswith(root), "outside the root")
    return reason


def guarded(sources: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Documents that may be read, and (source_path, reason) of the others."""
    marked = sources.withColumn(REASON, guard_reason(config, F.col("source_path"), F.col("source_size")))
    return marked.filter(F.col(REASON).isNull()).drop(REASON), marked.filter(F.col(REASON).isNotNull()).select("source_path", REASON)


def docx_text(content: bytes) -> str:
    """Paragraphs outside tables of a word-processor file, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")

    def run(p: ElementTree.Element) -> str:
        return "".join(t.text or "" if t.tag == f"{_WORD}t" else "\t" if t.tag == f"{_WORD}tab" else "\n" if t.tag in (f"{_WORD}br", f"{_WORD}cr") else "" for t in p.iter())

    return "\n".join(run(p) for p in (body.findall(f"{_WORD}p") if body is not None else ()))


def pdf_pages(content: bytes, most: int) -> list[tuple[int, str]]:
    """(page from 1, text) of pages that have text; needs one of the optional PDF readers."""
    try:
        import fitz
    except ImportError:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as doc:
            texts = [p.extract_text() or "" for p in doc.pages[: most + 1]]
    else:
        with fitz.open(stream=content, filetype="pdf") as doc:
            texts = [p.get_text() for p in doc] if doc.page_count <= most else [""] * doc.page_count
    if len(texts) > most:
        raise ValueError(f"more than {most} pages")
    return [(i, t) for i, t in enumerate(texts, 1) if t.strip()]


def page_reader(most: int, pdf_reader=pdf_pages):
    """A table function of (content, file_type): a row for each page that has text, numbered as the reader numbers them (all of
    a word-processor file is one, without a number), or one row with the reason where the file can't be read.

    A reader gets the content and the most pages that a document may have, and gives (page from 1, text) of each page or raises.
    """

    class Pages:
        def eval(self, content, kind):
            try:
                found = [(None, docx_text(content))] if kind == "docx" else pdf_reader(content, most)
                for page, text in found:
                    if text.strip():
                        yield page, text, None
            except Exception as e:  # noqa: BLE001  whatever a damaged file brings up is its reason
                yield None, None, f"{type(e).__name__}: {e}"[:200]

    return F.udtf(Pages, returnType=f"page int, text string, {REASON} string")


def pages_of(sources: DataFrame, config: EngineConfig, pdf_reader=pdf_pages) -> tuple[DataFrame, DataFrame]:
    """(source columns, page, text) of all documents, and (source_path, reason) of those that can't be read.

    Plain texts never leave the JVM; word-processor and paged documents are joined laterally with the pages that a table
    function reads from each, so that one bad file doesn't stop the others.
    """
    names = [f.name for f in SOURCES]
    plain = sources.filter("file_type = 'text'").select(*names, F.lit(None).cast("int").alias("page"), valid_text("content").alias("text"), F.lit(None).cast("string").alias(REASON))
    paged = sources.filter("file_type IN ('pdf', 'docx')").select(*names, "content")
    read = page_reader(config.max_pdf_pages, pdf_reader)
    other = paged.lateralJoin(read(F.col("content").outer(), F.col("file_type").outer())).select(*names, "page", "text", REASON)
    both = written(plain.unionByName(other), "pages")  # errors, chunks and vectors all read them
    return both.filter(F.col(REASON).isNull()).select(*[f.name for f in PAGES]), both.filter(F.col(REASON).isNotNull()).select("source_path", REASON)


def document_text(pages: DataFrame) -> DataFrame:
    """(source_id, text): the pages of each document in order, joined by line feeds."""
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("page"), "text")))
    return pages.groupBy("source_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))
