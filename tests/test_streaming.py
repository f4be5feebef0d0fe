"""The directory source and keyed state against plain replays."""

import datetime
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from skeinwork.config import EngineConfig
from skeinwork.engine import Engine
from skeinwork.streaming import source, state, watch


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_differences_of_listings():
    old = {"/a": (1, 10), "/b": (2, 20), "/c": (3, 30), "/d": (4, 40), "/e": (4, 40)}
    new = {"/a": (1, 10), "/b": (2, 21), "/x": (3, 30), "/f": (4, 40), "/n": (9, 90)}
    assert source.differences(old, new) == [("modified", "/b", None, 2, 21), ("moved", "/c", "/x", 3, 30), ("deleted", "/d", None, 4, 40), ("deleted", "/e", None, 4, 40), ("created", "/f", None, 4, 40), ("created", "/n", None, 9, 90)]
    assert source.differences({}, {}) == [] and source.listing("/nowhere") == {}


def test_directory_stream_and_restart(spark, tmp_path):
    folder, log, got = tmp_path / "in", str(tmp_path / "log"), []

    def run(then=None):
        stream = source.directory_changes(spark, str(folder), log)

        def batch(df, _):
            got.append([(r["kind"], os.path.basename(r["path"]), r["dest"] and os.path.basename(r["dest"])) for r in df.orderBy("seq").collect()])
            if then:
                then()

        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return q

    a, b = write(folder / "a.txt", "one"), write(folder / "b.txt", "two!")
    run()
    assert got.pop() == [("created", "a.txt", None), ("created", "b.txt", None)]
    run()
    assert got == []  # nothing changed
    write(a, "other")
    os.rename(b, folder / "c.txt")
    write(folder / "d.txt", "new")
    run()  # a restart from the checkpoint
    assert got.pop() == [("modified", "a.txt", None), ("moved", "b.txt", "c.txt"), ("created", "d.txt", None)]
    os.remove(a)
    with pytest.raises(Exception, match="stop here"):
        run(lambda: (_ for _ in ()).throw(ValueError("stop here")))
    assert got.pop() == [("deleted", "a.txt", None)]
    os.remove(folder / "d.txt")  # while it was down
    run()
    run()  # a run that begins with a failed batch may end with it
    assert got == [[("deleted", "a.txt", None)], [("deleted", "d.txt", None)]]  # the failed batch as it was, then the rest
    assert len(os.listdir(log)) <= 2


def replay(events, seconds):
    """Bursts and seen marks of each path, one event after the other."""
    out, by_path = [], {}
    for e in sorted(events, key=lambda e: (e[3], e[2])):
        by_path.setdefault(e[0], []).append(e)
    for path, es in by_path.items():
        seen, burst = None, []
        for k, e in enumerate(es):
            burst.append(e)
            if k + 1 < len(es) and (es[k + 1][3] - e[3]).total_seconds() < seconds:
                continue
            if e[1] == watch.DELETE:
                seen = None
                out.append((path, e[1], e[2], len(burst)))
            elif seen != e[4:]:
                seen = e[4:]
                out.append((path, e[1], e[2], len(burst)))
            burst = []
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_settled_actions_are_a_plain_replay(spark, tmp_path, seed):
    r, at = random.Random(seed), datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    events = [(f"/w/{r.randrange(5)}.txt", r.choice([watch.UPSERT, watch.UPSERT, watch.DELETE]), i, at + datetime.timedelta(milliseconds=r.randrange(60_000)), r.randrange(2), r.randrange(2)) for i in range(120)]
    events.sort(key=lambda e: (e[3], e[2]))
    schema = "path string, action string, seq long, ts timestamp, size long, mtime_ns long"
    last = [("/w/last.txt", watch.UPSERT, 999, at + datetime.timedelta(hours=1), 0, 0)]
    for k in range(0, 120, 40):  # later batches go on with the bursts of earlier ones
        spark.createDataFrame(events[k : k + 40] + (last if k == 80 else []), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = []
    with state.rocks(spark):
        q = state.settled(stream, 2, "30 seconds").writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted((x["path"], x["action"], x["seq"], x["events"]) for x in rows) == replay(events, 2)


def test_engine_follows_a_directory(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), config=EngineConfig(min_k=3))
    folder = tmp_path / "d"
    a, b = write(folder / "a.txt", "first words"), write(folder / "b.txt", "second words")
    engine.build([a, write(folder / "gone.txt", "words that go")])
    os.remove(folder / "gone.txt")
    held = lambda: {r["source_name"]: r["text"] for r in engine.store.table("chunks").collect()}
    query = engine.watch(str(folder), str(tmp_path / "cp"), seconds=0.2)

    def until(want):
        end = time.time() + 90
        while held() != want and time.time() < end:
            assert query.isActive, query.exception()
            time.sleep(0.3)
        assert held() == want

    try:
        until({"a.txt": "first words", "b.txt": "second words"})
        write(a, "changed words")
        os.rename(b, folder / "c.txt")
        until({"a.txt": "changed words", "c.txt": "second words"})
        build, broken = engine.build, []

        def fails_once(paths, force=False):
            if not broken:
                broken.append(paths)
                raise OSError("disk full")
            return build(paths, force)

        engine.build = fails_once
        write(folder / "e.txt", "later words")
        until({"a.txt": "changed words", "c.txt": "second words", "e.txt": "later words"})
    finally:
        query.stop()
    errors, progress = engine.error_table.collect(), engine.progress_table.orderBy("batch").collect()
    assert broken and [r["reason"] for r in errors] == ["OSError: disk full"] and errors[0]["run"] == "cp"
    assert sum(r["upserts"] for r in progress) >= 4 and sum(r["deletes"] for r in progress) >= 2 and progress[-1]["version"] == engine.store.version
    assert all(r["chunks"] is not None for r in progress)


def test_records_of_a_batch_are_written_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.error_table.count() == 0 and engine.progress_table.count() == 0
    for _ in range(2):  # a batch that is run again
        engine.store.record("errors", "run", 7, [("/x", "bad"), ("/y", "worse")])
        engine.store.record("errors", "run", 8, [("/x", "bad")])
    assert sorted((r["run"], r["batch"], r["source"]) for r in engine.error_table.collect()) == [("run", 7, "/x"), ("run", 7, "/y"), ("run", 8, "/x")]
    engine.store.record("errors", "run", 8, [])
    assert engine.error_table.filter(F.col("batch") == 8).count() == 0


def test_a_build_counts_what_it_writes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    engine.build([write(tmp_path / "a.txt", "one"), write(tmp_path / "b.txt", "two"), write(tmp_path / "bad.docx", "no archive")])
    assert engine.store.pointer()["written"]["sources"] == 3 and engine.store.pointer()["written"]["chunks"] == 2
    assert [(r["run"], r["batch"], os.path.basename(r["source"])) for r in engine.error_table.collect()] == [("build", 1, "bad.docx")]
