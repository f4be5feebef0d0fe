"""Pages of documents by a table function, with a reader of one's own."""

import os
import sys
import types


from skeinwork.config import EngineConfig
from skeinwork.engine import Engine
from skeinwork.sources import files


def form_feeds():
    def reader(content, most):
        """Pages between form feeds; empty ones keep their number."""
        pages = content.decode().split("\f")
        if pages[0] != "PAGED":
            raise ValueError("no pages here")
        if len(pages) - 1 > most:
            raise ValueError(f"more than {most} pages")
        return [(i, t) for i, t in enumerate(pages[1:], 1) if t.strip()]

    return reader  # a function of a function goes to the workers whole


reader = form_feeds()


def write(path, data):
    with open(path, "wb") as f:
        f.write(data.encode())
    return str(path)


def test_numbers_cap_and_damage(spark, tmp_path):
    paths = [write(tmp_path / "gaps.pdf", "PAGED\ffirst\f \f\fthird last"), write(tmp_path / "blank.pdf", "PAGED\f \f"), write(tmp_path / "long.pdf", "PAGED" + "\fx" * 6), write(tmp_path / "bad.pdf", "torn"), write(tmp_path / "plain.txt", "words")]
    pages, failed = files.pages_of(files.read_files(spark, paths), EngineConfig(max_pdf_pages=5), reader)
    assert sorted((r["source_name"], r["page"], r["text"]) for r in pages.collect() if r["page"]) == [("gaps.pdf", 1, "first"), ("gaps.pdf", 4, "third last")]
    assert {r["source_name"] for r in pages.collect()} == {"gaps.pdf", "plain.txt"}
    assert {os.path.basename(r["source_path"]): r["reason"] for r in failed.collect()} == {"long.pdf": "ValueError: more than 5 pages", "bad.pdf": "ValueError: no pages here"}


def test_table_function_in_sql(spark):
    spark.udtf.register("read_pages", files.page_reader(3, reader))
    spark.createDataFrame([(1, b"PAGED\fone\ftwo", "pdf"), (2, b"torn", "pdf"), (3, None, "pdf")], "id int, content binary, kind string").createOrReplaceTempView("paged")
    rows = spark.sql("SELECT id, page, text, reason IS NOT NULL AS bad FROM paged, LATERAL read_pages(content, kind)").collect()
    assert sorted((r["id"], r["page"] or 0, r["text"], r["bad"]) for r in rows) == [(1, 1, "one", False), (1, 2, "two", False), (2, 0, None, True), (3, 0, None, True)]


def fake_fitz(pages):
    class Document:
        page_count = len(pages)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def __iter__(self):
            return iter(types.SimpleNamespace(get_text=lambda t=t: t) for t in pages)

    return types.SimpleNamespace(open=lambda stream, filetype: Document())


def test_readers_of_both_libraries(monkeypatch):
    pages = ["one", "", "three"]
    monkeypatch.setitem(sys.modules, "fitz", fake_fitz(pages))
    assert files.pdf_pages(b"", 3) == [(1, "one"), (3, "three")]
    for most in (2, 1):
        try:
            files.pdf_pages(b"", most)
        except ValueError as e:
            assert str(e) == f"more than {most} pages"
        else:
            raise AssertionError
    monkeypatch.setitem(sys.modules, "fitz", None)  # not installed

    class Plumbed:
        def __init__(self):
            self.pages = [types.SimpleNamespace(extract_text=lambda t=t: t or None) for t in pages]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda _: Plumbed()))
    assert files.pdf_pages(b"", 3) == [(1, "one"), (3, "three")]


def test_pages_reach_chunks_and_questions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.pages_of, "__defaults__", (reader,))
    engine = Engine(spark, str(tmp_path / "index"), config=EngineConfig(min_k=3))
    engine.build([write(tmp_path / "a.pdf", "PAGED\fNorthern lights\f\fglow over Norway"), write(tmp_path / "bad.pdf", "torn")])
    assert {(r["page"], r["text"]) for r in engine.store.table("chunks").collect()} >= {(3, "glow over Norway")}
    assert [r["reason"] for r in engine.error_table.collect()] == ["ValueError: no pages here"]
    assert "Norway" in "".join(engine.answer("Where in Norway")[0])
