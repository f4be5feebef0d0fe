import datetime
import hashlib
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from skeinwork.config import EngineConfig
from skeinwork.console import HELP, Console
from skeinwork.engine import REFUSAL, Engine
from skeinwork.operators import index
from skeinwork.sources import files
from skeinwork.streaming import watch


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "index"), config=EngineConfig(min_k=3))


def test_versions(engine, tmp_path):
    left, right = write(tmp_path / "left/report.txt", "same reusable paragraph"), write(tmp_path / "right/report.txt", "same reusable paragraph")
    assert engine.prepare([left, right]) == 1 and engine.prepare([left, right]) == 1
    assert engine.store.table("sources").count() == 2 and engine.store.table("chunks").select("chunk_id").distinct().count() == 2
    old = engine.store.table("chunks")
    write(left, "changed left source")
    assert engine.prepare([left, right]) == 2
    assert {r["text"] for r in engine.store.table("chunks").collect()} == {"changed left source", "same reusable paragraph"}
    assert {r["text"] for r in old.collect()} == {"same reusable paragraph"}  # a reader keeps its version
    assert engine.remove(path=right) == 1 and engine.store.version == 3
    assert engine.remove(path="/nowhere/report.txt") == 0 and engine.store.version == 3
    ids = {r[0] for r in engine.store.table("chunks").select("chunk_id").collect()}
    assert ids == {r[0] for r in engine.store.table("tokens").select("chunk_id").collect()} == {r[0] for r in engine.store.table("vectors").select("chunk_id").collect()} and len(ids) == 1
    manifest = index.manifest(engine.store.table("sources"), engine.store.table("chunks")).collect()
    assert len(manifest) == 1 and set(manifest[0]["chunk_ids"]) == ids


def test_failed_change_leaves_the_version(engine, tmp_path, monkeypatch):
    notes = write(tmp_path / "notes.txt", "before")
    engine.build([notes])
    write(notes, "after")
    monkeypatch.setattr(engine.store, "_swap", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        engine.build([notes])
    assert engine.store.version == 1 and engine.store.table("chunks").first()["text"] == "before" and not engine.store.has("chunks", 2)


def test_answers(engine, tmp_path):
    a = write(tmp_path / "a.md", "Northern lights glow green. Aurora Borealis appears in Norway and Finland.")
    b = write(tmp_path / "b.md", "Bread needs flour and water. Aurora Borealis is no bread. Norway bakes.")
    engine.build([a, b])
    parts, sources = engine.answer("Where is Aurora Borealis seen in Norway")
    text = "".join(parts)
    assert "[Citation: S1]" in text and sources.startswith("[S1] a.md") and engine.stats()["chunks"] == 2
    with pytest.raises(ValueError):
        engine.store.load_graph()
    engine.build_graph()
    assert engine.store.load_graph()[0].count() >= 1
    assert "Aurora" in "".join(engine.answer("Aurora Borealis", use_graph=True)[0])
    assert engine.metrics.count() == 2
    engine.config = EngineConfig(min_k=3, refusal_threshold=9.0)
    parts, sources = engine.answer("Aurora")
    assert "".join(parts) == REFUSAL and sources == ""
    engine.build([a])
    assert not engine.store.has("edges")  # a new version has no graph yet


def test_sub_queries(engine):
    assert engine.sub_queries("one two three") == ["one two three"]
    engine.decompose = lambda q: '["a", "b"]'
    assert engine.sub_queries("one two three") == ["a", "b"] and engine.sub_queries("hi") == ["hi"]
    engine.decompose = lambda q: 1 / 0
    assert engine.sub_queries("one two three") == ["one two three"]


def test_guards_and_docx(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", body)
    write(tmp_path / "bad.docx", "no archive")
    write(tmp_path / "big.txt", "x" * 5000)
    write(tmp_path / ".env", "KEY=1")
    write(tmp_path / "ok.txt", "fine")
    config = EngineConfig(max_document_bytes=4000)
    all_ = [str(tmp_path / n) for n in ("d.docx", "bad.docx", "big.txt", ".env", "ok.txt", "gone.txt")]
    sources, refused = files.guarded(files.read_files(spark, all_), config)
    assert {os.path.basename(r[0]): r[1] for r in refused.collect()} == {"big.txt": "too large"}
    assert [r["reason"] for r in spark.createDataFrame([("/x/.env", 1), ("/x/a..b.txt", 1)], "p string, n long").select(files.guard_reason(config, F.col("p"), F.col("n")).alias("reason")).collect()] == ["secret file", "path"]
    pages, failed = files.pages_of(sources, config)
    assert {r["source_name"]: r["text"] for r in pages.collect()} == {"d.docx": "One\nTwo", "ok.txt": "fine"}
    assert [os.path.basename(r[0]) for r in failed.collect()] == ["bad.docx"]
    assert {os.path.basename(r["path"]) for r in files.list_files(spark, str(tmp_path)).collect()} == {"d.docx", "bad.docx", "big.txt", "ok.txt"}
    assert files.source_id(all_[4]) == sources.filter("source_name = 'ok.txt'").first()["source_id"]


def test_events(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, at(0), "created", "/w/a.txt", None), (2, at(1), "modified", "/w/a.txt", None), (3, at(5), "moved", "/w/a.txt", "/w/b.txt"), (4, at(6), "created", "/w/.x.txt", None), (5, at(7), "moved", "/w/c.txt", "/out/c.txt"), (6, at(8), "deleted", "/w/b.txt", None)]
    e = spark.createDataFrame(rows, "seq long, ts timestamp, kind string, path string, dest string")
    acts = watch.actions(e, "/w").orderBy("seq", "part")
    assert [(r["seq"], r["path"], r["action"]) for r in acts.collect()] == [(1, "/w/a.txt", "upsert"), (2, "/w/a.txt", "upsert"), (3, "/w/a.txt", "delete"), (3, "/w/b.txt", "upsert"), (5, "/w/c.txt", "delete"), (6, "/w/b.txt", "delete")]
    assert [r["seq"] for r in watch.debounce(acts, "path", 2).orderBy("seq").collect()] == [2, 3, 3, 5, 6]
    assert {r["path"]: r["action"] for r in watch.final_actions(acts).collect()} == {"/w/a.txt": "delete", "/w/b.txt": "delete", "/w/c.txt": "delete"}


def test_stream_and_watch(spark, engine, tmp_path):
    events = tmp_path / "events"
    rows = [("/w/a.txt", "upsert", datetime.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 9)]
    spark.createDataFrame(rows, "path string, action string, ts timestamp").write.parquet(str(events))
    stream = spark.readStream.schema("path string, action string, ts timestamp").parquet(str(events))
    q = watch.debounced_stream(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["events"] for r in spark.table("bursts").collect()) == [1, 2]

    folder = tmp_path / "watched"
    a, b = write(folder / "a.txt", "first"), write(folder / "b.txt", "second")
    engine.build([a])
    write(a, "changed")
    ticks = spark.readStream.schema("path string, action string, ts timestamp").parquet(str(events))
    query = watch.watch(spark, ticks, lambda: watch.listing_changes(files.as_sources(spark.read.format("binaryFile").load(str(folder))), engine.store.table("sources")), lambda found, n: engine.build([r["path"] for r in found.collect()]), lambda n, e: engine.errors.append((n, str(e))), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert engine.errors == [] and {r["text"] for r in engine.store.table("chunks").collect()} == {"changed", "second"}
    os.remove(b)
    now = files.as_sources(spark.read.format("binaryFile").load(str(folder)))
    assert [(os.path.basename(r["path"]), r["kind"]) for r in watch.listing_changes(now, engine.store.table("sources")).collect()] == [("b.txt", "delete")]
    assert engine.remove(path=b) == 1


def test_rebuild_decisions(engine, spark, tmp_path):
    a = write(tmp_path / "a.txt", "text")
    read = lambda: files.read_files(spark, [a])
    assert engine.store.rebuild_needed(engine.config, read())
    engine.build([a])
    assert not engine.store.rebuild_needed(engine.config, read()) and engine.store.rebuild_needed(engine.config, read(), force=True)
    assert engine.store.rebuild_needed(EngineConfig(embedding_model="other"), read())
    write(a, "new text")
    assert engine.store.rebuild_needed(engine.config, read())
    assert engine.check_endpoint("http://x/") == "remote http" and engine.store.table("chunks").filter(F.col("chunk_index") == 0).count() == 1


def test_two_writers(engine, spark, tmp_path, monkeypatch):
    a, b = write(tmp_path / "a.txt", "first"), write(tmp_path / "b.txt", "second")
    engine.build([a])
    other = Engine(spark, str(tmp_path / "index"), config=engine.config)
    publish = engine.store._swap

    def late(*args):  # another writer publishes while this one has only written its tables
        other.build([b])
        publish(*args)

    monkeypatch.setattr(engine.store, "_swap", late)
    with pytest.raises(index.Conflict):
        engine.build([write(tmp_path / "c.txt", "third")])
    assert engine.store.version == other.store.version == 2 and engine.status()["last_error"].startswith("build")
    assert {r["text"] for r in engine.store.table("chunks").collect()} == {"first", "second"}
    assert len([n for n in os.listdir(tmp_path / "index/default") if n.startswith("v")]) == 2  # nothing of the one that lost
    monkeypatch.undo()
    assert engine.build([str(tmp_path / "c.txt")]) == 3 and engine.status() == {"pending": 0, "running": False, "last_error": None}
    assert engine.prune(1) == [1, 2] and engine.prune(1) == [] and engine.store.table("chunks").count() == 3
    assert engine.store.table("chunks", 1).count() == 0 and engine.remove(path=b) == 1 and engine.store.version == 4


def test_pages_are_read_once(spark, tmp_path):
    write(tmp_path / "one.pdf", "%PDF")
    write(tmp_path / "long.pdf", "%PDF-long")
    calls = spark.sparkContext.accumulator(0)

    def reader(content, most):
        calls.add(1)
        if b"long" in content:
            raise ValueError(f"more than {most} pages")
        return [(1, "front"), (3, "back")]

    pages, failed = files.pages_of(files.read_files(spark, [str(tmp_path / n) for n in ("one.pdf", "long.pdf")]), EngineConfig(), reader)
    assert [(r["page"], r["text"]) for r in pages.orderBy("page").collect()] == [(1, "front"), (3, "back")] and pages.count() == 2
    assert [(os.path.basename(r[0]), r[1]) for r in failed.collect()] == [("long.pdf", "ValueError: more than 2000 pages")]
    assert calls.value == 2


def test_console(engine, tmp_path):
    a = write(tmp_path / "a.md", "Northern lights glow green. Aurora Borealis appears in Norway and Finland.")
    b = write(tmp_path / "b.md", "Bread needs flour and water. Aurora Borealis is no bread. Norway bakes.")
    steps, shown = [], []
    engine.progress = steps.append
    lines = iter([f"/files add {a},{b}", "/files list", "/mode graph", "Where is Aurora Borealis", "/alpha 7", "/set min_k 0", "/set top_k -1", "/set nothing 1", "/files stop", "/mode other", "", "/files remove " + b, "/quit", "never"])
    console = Console(engine, ask=lambda _: next(lines), say=shown.append)
    console.run()
    assert shown[0] == "version 1" and shown[1].splitlines() == [a, b] and shown[2] == "mode graph"
    assert "Aurora" in shown[3] and [q for q, _ in console.history] == ["Where is Aurora Borealis"]
    assert shown[4:6] == ["alpha = 1.0", "min_k = 1"] and "top_k must be positive" in shown[6] and shown[7] == "no such setting: nothing"
    assert shown[8] == "not watching" and shown[9] == HELP and shown[10] == "1 chunks removed" and len(shown) == 11
    assert steps == ["build: begun", "build: done", "graph: begun", "graph: done", "remove: begun", "remove: done"]
    assert "top_k = 70" in console.settings() and Console(engine, ask=lambda _: (_ for _ in ()).throw(EOFError)).run() is None


def test_fingerprint_of_chunks(spark):
    rows = [(f"c{k % 700}", f"{k * 7919 % 1000:03d}é") for k in range(1500)] + [(None, "x"), ("c", None)]
    df = spark.createDataFrame(rows, "chunk_id string, content_sha256 string").repartition(7)
    lines = sorted(f'{{"chunk_id": "{a or "null"}", "content_sha256": "{b or "null"}"}}' for a, b in rows)
    assert [r["fingerprint"] for r in index.chunks_fingerprint(df).collect()] == [hashlib.sha256(f"[{', '.join(lines)}]".encode()).hexdigest()]
    for none in (df.limit(0), df.filter("1 = 0")):
        assert [r["fingerprint"] for r in index.chunks_fingerprint(none).collect()] == [hashlib.sha256(b"[]").hexdigest()]
