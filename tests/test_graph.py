"""The entity graph under changes, blocks of pairs, and answers that are kept."""

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from skeinwork.config import EngineConfig
from skeinwork.engine import Engine
from skeinwork.operators import graph

NAMES = "Aurora Borealis Norway Finland Sweden Copper Granite Harbor Lantern Meadow".split()


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_graph_follows_random_changes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), config=EngineConfig(min_cooccur=2, max_entities=4))
    asked = spark.sparkContext.accumulator(0)

    def extract(chunks):
        count = F.udf(lambda x: asked.add(1) or x)
        return graph.extract(chunks.withColumn("text", count("text")), "chunk_id")

    engine.extract = extract
    r = random.Random(6)
    for step in range(4):
        changed = [write(tmp_path / f"d/{k}.txt", " ".join(r.sample(NAMES, r.randrange(1, 7)))) for k in r.sample(range(8), 6 if not step else 2)]
        engine.build(changed)
        if step == 2:
            engine.remove(path=changed[0])
        before = asked.value
        engine.build_graph()
        if step:
            assert asked.value - before <= 2  # only chunks that came
        lists = graph.extract(engine.store.table("chunks"), "chunk_id")
        edges, mentions = engine.store.load_graph()
        assert rows(edges, "u", "v", "weight") == rows(graph.edges(lists, 2, 4), "u", "v", "weight")
        assert rows(mentions, "entity", "chunk_id") == rows(graph.mentions(lists), "entity", "id")
    engine.config = EngineConfig(min_cooccur=1, max_entities=9)  # other bounds: pairs are formed anew
    engine.build([changed[1]])
    engine.build_graph()
    assert rows(engine.store.load_graph()[0], "u", "v", "weight") == rows(graph.edges(graph.extract(engine.store.table("chunks"), "chunk_id"), 1, 9), "u", "v", "weight")


def test_questions_are_read_by_the_same_extractor(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), config=EngineConfig(min_k=3, min_cooccur=1), extract=lambda c: c.select(F.col("chunk_id").alias("id"), F.filter(F.split(F.lower("text"), " "), lambda w: w.startswith("x")).alias("entities")))
    engine.build([write(tmp_path / "a.txt", "xray xenon lamp"), write(tmp_path / "b.txt", "bread and butter"), write(tmp_path / "c.txt", "xenon glows")])
    engine.build_graph()
    found = [r["text"] for r in engine.graph_retrieve("what is xray").orderBy("rank").collect()]
    assert found[0] == "xray xenon lamp" and "xenon glows" in found  # by the graph: no word of the question is in it


def plain_pairs(data, least):
    groups = collections.defaultdict(set)
    for g, i in data:
        if g is not None and i is not None:
            groups[g].add(i)
    counts = collections.Counter((a, b) for s in groups.values() for a in s for b in s if a < b)
    return sorted((a, b, n) for (a, b), n in counts.items() if n >= least)


@pytest.mark.parametrize("block", [3, 7, 256])
def test_pairs_in_blocks(spark, block):
    r = random.Random(block)
    data = [(r.randrange(6), r.randrange(30)) for _ in range(150)] + [(9, i) for i in range(25)] + [(None, 1), (1, None), (2, 2), (2, 2)]
    df = spark.createDataFrame(data, "g long, i long")
    assert rows(graph.pair_counts(df, "g", "i", 2, block), "u", "v", "weight") == plain_pairs(data, 2)


def test_a_large_group_is_never_in_one_row(spark):
    df = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("i"))
    blocks = graph.pair_blocks(df, "g", "i", 1000)
    sizes = blocks.select(F.size("x").alias("x"), F.size("y").alias("y"), "i", "j")
    row = sizes.agg(F.count("*").alias("n"), F.max("x").alias("most"), F.sum(F.when(F.col("i") < F.col("j"), F.col("x").cast("long") * F.col("y")).otherwise(F.col("x").cast("long") * (F.col("x") - 1) / 2)).alias("pairs")).first()
    assert row["n"] == 100 * 101 / 2 and row["most"] < 1200 and row["pairs"] == 100_000 * 99_999 / 2


def test_answers_are_kept_by_text(spark, tmp_path):
    asked, cache = spark.sparkContext.accumulator(0), str(tmp_path / "answers")

    def ask(texts):
        asked.add(len(texts))
        if any("bad" in t for t in texts):
            raise ValueError("no answer")
        return "\n".join(f"[Passage {i}]\n" + "\n".join(f"- {w}" for w in t.split()) for i, t in enumerate(texts, 1))

    df = spark.createDataFrame([(1, "Alpha Beta"), (2, "Gamma"), (3, "Alpha Beta"), (4, None), (5, "bad Delta")], "id long, text string")
    run = lambda d: {r["id"]: r["entities"] for r in graph.extract_with(d, "id", ask, size=1, cache=cache).collect()}
    first = run(df)
    assert asked.value == 3 and first[4] == first[5] == [] and first[1] == first[3]
    assert first == {r["id"]: r["entities"] for r in graph.extract_with(df, "id", ask, size=1).collect()}
    before = asked.value
    assert run(df) == first and asked.value == before + 1  # only the failed one again
    assert {r["key"] for r in graph.cached(spark, cache).collect()} == {r[0] for r in df.filter("id IN (1, 2)").select(F.sha2("text", 256)).collect()}
    before = asked.value
    assert run(df.filter("id < 4").unionByName(spark.createDataFrame([(6, "Omega")], df.schema)))[2] == first[2] and asked.value == before + 1


def test_tasks_of_pairs_and_of_later_hops_are_bounded(spark, monkeypatch):
    """As many tasks as the rows take, whatever the number of shuffle partitions; the results stay."""
    r = random.Random(3)
    data = [(r.randrange(60), r.randrange(40)) for _ in range(900)]
    df = spark.createDataFrame(data, "g long, i long")
    lists = df.groupBy(F.col("g").alias("id")).agg(F.sort_array(F.collect_set(F.col("i").cast("string"))).alias("entities"))
    asked = spark.createDataFrame([(q, str(q)) for q in range(9)], "query_id long, entity string")
    two = lambda: rows(graph.related(graph.edges(lists, count=60), asked, max_hops=2, top_k=15), "query_id", "entity", "score", "rank")
    before = two()
    for name, each in (("ROWS_EACH", 50), ("PAIRS_EACH", 100), ("LISTS_EACH", 5)):
        monkeypatch.setattr(graph, name, each)
    assert two() == before
    counted = graph.pair_counts(df, "g", "i")
    assert rows(counted, "u", "v", "weight") == plain_pairs(data, 2)
    assert counted.rdd.getNumPartitions() > 18
