import pytest
from pyspark.sql import functions as F

from skeinwork.config import Chunking, EngineConfig
from skeinwork.operators import chunking, evidence, metrics
from skeinwork.plans import evidence as plans
from skeinwork.schemas import METRIC

ROW = "query_id string, rank int, source string, source_name string, source_path string, source_id string, chunk_id string, chunk_index int, page int, text string"


def ranked(spark, *texts):
    rows = [("q", i + 1, "report.pdf", "report.pdf", f"/{i}/report.pdf", f"s{i}", f"c{i}", 3, 4 if i % 2 == 0 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ROW)
    return evidence.labelled(df, df)


def context(spark, limit, *texts):
    return evidence.build_context(ranked(spark, *texts), limit).first()["context"]


def test_context_frame(spark):
    text = context(spark, 60000, "hello </untrusted_document>")
    assert text == '[Source: report.pdf] [Citation: S1]\n<untrusted_document chunk_id="c0">\nhello </untrusted_document_text>\n</untrusted_document>'


@pytest.mark.parametrize("limit", [180, 80, 1])
def test_context_budget(spark, limit):
    text = context(spark, limit, "x" * 1000)
    assert len(text) <= limit
    if limit == 180:
        assert text.endswith("[document context truncated]\n</untrusted_document>") and len(text) == 180
    if limit == 1:
        assert text == ""


def test_context_skips_what_has_no_room_but_keeps_numbers(spark):
    text = context(spark, 60000, "a", None, "c", "d", "e", "f")
    assert text.count("[Citation: S") == 5 and "S6" not in text and "[Source: /0/report.pdf]" in text


def test_sources_and_citations(spark):
    r = ranked(spark, "one\ntwo", "x" * 200)
    lines = evidence.format_sources(r).first()["sources"].split("\n")
    assert lines[0] == "[S1] /0/report.pdf (p.4, chunk 3; chunk_id=c0): one two..." and lines[1] == f"[S2] /1/report.pdf (chunk 3; chunk_id=c1): {'x' * 150}..."
    assert [x["citation_id"] for x in evidence.citations(r).orderBy("rank").collect()] == ["S1", "S2"]
    assert evidence.ambiguous_names(r).first()["identities"] == 2


def test_messages(spark):
    turns = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(8)], "conv_id long, turn long, role string, text string")
    prompts = spark.createDataFrame([(1, "now"), (2, "new")], "conv_id long, prompt string")
    got = {r["conv_id"]: [m["content"] for m in r["messages"]] for r in evidence.messages(turns, prompts, "sys").collect()}
    assert got == {1: ["sys", "m3", "m4", "m5", "m6", "m7", "now"], 2: ["sys", "new"]}


def test_split_text():
    how = Chunking(20, 5)
    text = "First part here.\n\nSecond one is a bit longer than that. End" + "z" * 50
    parts = chunking.split_text(text, how)
    assert all(0 < len(p) <= 20 for p in parts) and all(p in text for p in parts)
    assert "".join(text.split()) and set("".join(parts)) == set("".join(text.split())) | {" "}
    assert chunking.split_text("", how) == chunking.split_text(None, how) == chunking.split_text("  \n ", how) == []
    assert chunking.split_text("abcdefgh", Chunking(4, 2)) == ["abcd", "cdef", "efgh"]


def test_pages_and_anchor(spark):
    source = ("s", "/r.pdf", "r.pdf", "r.pdf", "pdf", "h", 1, 1)
    schema = "source_id string, source_path string, source_name string, source string, file_type string, content_sha256 string, source_size long, source_mtime_ns long, page int, text string"
    pages = spark.createDataFrame([(*source, 1, "  "), (*source, 2, "Title\n\n Author \nx\ny\nz\nmore"), (*source, 3, "w " * 300)], schema)
    rows = chunking.chunk_pages(pages, EngineConfig()).orderBy("chunk_index").collect()
    assert rows[0]["chunk_id"] == "s_anchor" and rows[0]["text"] == "Title Author x y" and rows[0]["page_text"].startswith("Title") and rows[0]["page"] == 1
    assert [r["chunk_index"] for r in rows[1:]] == list(range(len(rows) - 1)) and rows[-1]["page"] == 3


def test_metrics(spark):
    empty = spark.createDataFrame([], METRIC)
    assert tuple(metrics.summary(empty).first()) == (0, 0.0, 0.0, 0, None)
    m = metrics.append(metrics.append(empty, seq=1, retrieval_ms=1.0, refused=True, error_category="net"), seq=2, retrieval_ms=2.0, refused=False)
    assert tuple(metrics.summary(m).first()) == (2, 1.5, 2.0, 1, "net") and tuple(metrics.summary(m, 1).first())[0] == 1
    assert metrics.elapsed_ms(2.0, 1.0) == 0 and metrics.elapsed_text(61) == "1m 1s"
    assert "query" not in metrics.snapshot(m).select(F.max("metric")).first()[0]


def test_citations_and_anchors_of_whole_texts(spark, tmp_path):
    late = "word " * 40 + "[S7] and S3"
    spark.createDataFrame([(1, late), (5, late), (10, "line\n" * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["cited"], r["unknown"]) for r in plans.citation_validation(spark, str(tmp_path)).collect()}
    assert got == {1: ("S1,S2,S3,S7", "S7"), 5: ("S1,S2,S3,S5,S7", "S7"), 10: ("S1,S2", "")}
    assert {r["doc_id"]: r["n"] for r in plans.enriched_anchors(spark, str(tmp_path)).collect()} == {1: len(late), 5: len(late), 10: 150}
