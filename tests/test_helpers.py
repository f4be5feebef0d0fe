"""One-call helpers, the command line, benchmark files, manifests, and chunks of whole tables."""

import hashlib
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from skeinwork import engine as engines
from skeinwork.config import Chunking, EngineConfig
from skeinwork.operators import chunking, evidence, index, lexical, quality
from skeinwork.plans import catalogue
from skeinwork.schemas import MANIFEST_SOURCES, SOURCES
from skeinwork.sources import files


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


@pytest.fixture
def papers(tmp_path):
    return [write(tmp_path / "d/harbor.md", "Harbor Lantern burns at night. The Granite pier is old."), write(tmp_path / "d/bread.txt", "Granite mills grind flour. Harbor bakers need water.")]


def test_names_of_collections(papers):
    name = files.collection_name(papers)
    assert name == files.collection_name(papers[::-1]) == "rag_" + hashlib.md5("|".join(sorted(papers)).encode()).hexdigest()[:8] != files.collection_name(papers[:1])


def test_one_call(spark, tmp_path, papers):
    root = str(tmp_path / "root")
    text, sources = engines.ask(spark, root, papers, "Where does the lantern burn", config=EngineConfig(min_k=3))
    assert "Lantern" in text and "harbor.md" in sources
    before = sorted(os.listdir(f"{root}/{files.collection_name(papers)}/log"))
    text, _ = engines.ask(spark, root, papers, "Harbor Granite", use_graph=True, config=EngineConfig(min_k=3, min_cooccur=1))
    assert "Granite" in text and sorted(os.listdir(f"{root}/{files.collection_name(papers)}/log")) == before  # nothing changed, nothing built
    write(papers[0], "The beacon is dark.")
    assert "beacon" in engines.ask(spark, root, papers, "beacon", config=EngineConfig(min_k=3))[0]


def test_command_line(spark, tmp_path, papers, capsys, monkeypatch):
    root = str(tmp_path / "root")
    engines.main(["--root", root, "--name", "n", "--files", ",".join(papers), "--query", "Where does the lantern burn"])
    assert "Lantern" in capsys.readouterr().out
    engines.main(["--root", root, "--name", "n", "--graph", "--query", "Harbor"])
    assert "[S1]" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("/quit\n"))
    engines.main(["--root", root, "--name", "n", "--interactive"])
    engines.main(["--root", root, "--name", "n", "--rebuild", "--files", papers[0]])
    assert [r[0] for r in engines.Engine(spark, root, "n").store.table("sources").select("source_name").collect()] == ["harbor.md"]
    with pytest.raises(SystemExit):
        engines.main([])


def test_benchmark_files(spark, tmp_path):
    corpus = [{"chunk_id": "tide-0", "text": "The tide table lists high water."}, {"chunk_id": "sail-0", "text": "Sails are mended in winter."}, {"chunk_id": "rope-0", "text": "Rope is kept dry."}]
    cases = [{"id": "tide", "query": "when is high water", "relevant_chunk_ids": ["tide-0"]}, {"id": "sail", "query": "who mended sails", "relevant_chunk_ids": ["sail-0"]}]
    path = write(tmp_path / "b.json", json.dumps({"schema_version": 1, "k": 1, "corpus": corpus, "cases": cases, "quality_gates": {"recall": 1.0, "mrr": 0.8}}, indent=1))
    b = quality.read_benchmark(spark, path)
    ix = lexical.build_index(lexical.tokens_of(b.corpus, "chunk_id"))
    means = quality.run_benchmark(b.cases, lambda q: lexical.bm25_top(ix, q, b.k).select("query_id", "id", "rank"), b.k)
    quality.assert_gates(means, b.gates)
    assert means.first()["queries"] == 2 and b.gates == {"recall": 1.0, "mrr": 0.8}
    for bad in ("[]", "{}", '{"cases": 3}', "not json", '{"corpus": []}'):
        with pytest.raises(ValueError):
            quality.read_benchmark(spark, write(tmp_path / "bad.json", bad))


def test_manifest_has_all_fields_of_a_source(spark, tmp_path, papers):
    e = engines.Engine(spark, str(tmp_path / "root"))
    e.build([*papers, write(tmp_path / "d/empty.txt", " \n")])
    chunks = e.store.table("chunks")
    found = index.manifest(e.store.table("sources"), chunks)
    assert found.columns == MANIFEST_SOURCES.names
    rows = {r["source_name"]: r.asDict() for r in found.collect()}
    assert set(rows) == {"harbor.md", "bread.txt", "empty.txt"} and rows["empty.txt"]["chunk_ids"] == []
    for path in papers:
        r, raw = rows[os.path.basename(path)], open(path, "rb").read()
        assert (r["source_id"], r["source_path"], r["file_type"], r["content_sha256"], r["source_size"]) == (files.source_id(path), path, "text", hashlib.sha256(raw).hexdigest(), len(raw))
        assert r["source_mtime_ns"] // 1_000_000 == os.stat(path).st_mtime_ns // 1_000_000 and len(SOURCES.names) == 8 and r["source"] is not None
        assert r["chunk_ids"] == sorted(x[0] for x in chunks.filter(F.col("source_id") == r["source_id"]).select("chunk_id").collect())


def test_chunks_cover_whole_texts(spark, sf):
    """All of every text but white space is in its chunks, in order; chunks are pieces of it, short enough, and overlap by no more
    than they may."""
    how = EngineConfig().chunking["text"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    chunks = {}
    for r in catalogue.QUERIES["chunk_documents"](spark, sf).orderBy("doc_id", "chunk_index").collect():
        chunks.setdefault(r["doc_id"], []).append(r["text"])
    assert set(chunks) == {d for d, t in texts.items() if t and t.strip()}
    for d, parts in chunks.items():
        text, reached, begun = texts[d], 0, 0
        for part in parts:
            assert part and part == part.strip() and len(part) <= how.size
            at = text.find(part, begun)
            assert at >= 0 and reached - at <= how.overlap and not text[min(reached, at) : at].strip()
            begun, reached = at, max(reached, at + len(part))
        assert not text[reached:].strip()


def test_last_turns_of_one_turn(spark):
    rows = [(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 2, "assistant", "c"), (1, 2, "user", "d")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
        assert sorted((r["back"], r["text"]) for r in evidence.last_turns(df, 3).collect()) == [(1, "d"), (2, "b"), (3, "c")]


def test_chunks_are_sent_on_before_a_batch_ends(spark, monkeypatch):
    how = Chunking(20, 5, ("\n", " ", ""))
    texts = [None, "", "one two three four five six seven eight nine " * 9, "short", "   ", "wörter und zeilen\n" * 30]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "text_ int, text string").coalesce(1)
    plain = [(k, at, c) for k, t in enumerate(texts) for at, c in enumerate(chunking.split_text(t, how))]
    for held in (1, 50, 1 << 20):
        monkeypatch.setattr(chunking, "HELD_CHARS", held)
        got = chunking.split_rows(df, how, ["text_"])
        assert got.columns == ["text_", "at", "chunk"] and [tuple(r) for r in got.collect()] == plain
