"""Segments, pruned ranking, and versions made of parts."""

import json
import math
import os
import random

import numpy as np
import pytest

from skeinwork.config import EngineConfig
from skeinwork.engine import Engine
from skeinwork.operators import index, lexical
from skeinwork.operators.store import scratch, shared_dir, written


def plain_bm25(texts, query, k, n=None):
    """(id, score) by the formula alone."""
    toks = {i: (t or "").lower().split() for i, t in texts.items()}
    size, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for ts in toks.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(size - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    score = lambda ts: sum(idf.get(q, 0) * ts.count(q) * 2.5 / (ts.count(q) + 1.5 * (0.25 + 0.75 * len(ts) / avg)) for q in query.lower().split())
    return sorted(((i, round(score(ts), 9)) for i, ts in toks.items()), key=lambda x: (-x[1], x[0]))[:k]


def corpus(seed, n, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{k}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return {i: " ".join(r.choices(vocabulary, weights, k=r.randrange(1, 40))) if i % 17 else None for i in range(n)}, vocabulary


def built(spark, texts, partitions, chunks=1 << 16):
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(partitions)
    tokens = lexical.tokens_of(df, "id")
    return lexical.build_index(tokens) if chunks == 1 << 16 else segmented(tokens, chunks)


def segmented(tokens, chunks):
    whole = lexical.build_index(tokens)
    return lexical.LexicalIndex(written(lexical.build_segments(tokens, "x", chunks), "segments"), whole.totals, whole.n, whole.avgdl, whole.mean)


@pytest.mark.parametrize(("seed", "n", "k", "chunks"), [(1, 300, 5, 1 << 16), (2, 200, 40, 16), (3, 12, 30, 4), (4, 60, 1, 7)])
def test_pruned_ranking_is_the_plain_one(spark, seed, n, k, chunks):
    texts, vocabulary = corpus(seed, n)
    r = random.Random(seed)
    asked = [" ".join(r.choices(vocabulary, k=r.randrange(1, 12))) for _ in range(15)] + ["unknown words", "", vocabulary[0], f"{vocabulary[0]} {vocabulary[0]} {vocabulary[59]}"]
    got = {}
    for row in lexical.bm25_top(built(spark, texts, 3, chunks), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), k).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = (row["id"], row["score"])
    for i, q in enumerate(asked):
        want = plain_bm25(texts, q, k)
        assert [got[i][j + 1][0] for j in range(len(want))] == [w[0] for w in want], (i, q)
        assert [got[i][j + 1][1] for j in range(len(want))] == pytest.approx([w[1] for w in want], abs=2e-9)


def test_words_that_most_chunks_have_rank_below_none(spark):
    texts = {0: "a b", 1: "a b", 2: "a b c", 3: None, 4: "a b", 5: "a b"}
    for q in ("a", "c a", "z"):
        rows = lexical.bm25_top(built(spark, texts, 2), spark.createDataFrame([("q", q)], "query_id string, query string"), 4).orderBy("rank").collect()
        assert [(r["id"], r["score"]) for r in rows] == plain_bm25(texts, q, 4)


def test_queries_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MAX_QUERIES", 4)
    monkeypatch.setattr(lexical, "MOST_NAMED", 2)
    texts, vocabulary = corpus(8, 80)
    asked = [(i, f"{vocabulary[i]} {vocabulary[-i - 1]}") for i in range(11)]
    rows = lexical.bm25_top(built(spark, texts, 2), spark.createDataFrame(asked, "query_id long, query string"), 3).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in rows) == [(i, j + 1, w[0]) for i, q in asked for j, w in enumerate(plain_bm25(texts, q, 3))]


def test_few_chunks_are_scored():
    """A query of a rare word and of words that nearly every chunk has: the common lists are only looked up."""
    r, size = np.random.default_rng(5), 20_000
    dl = r.integers(50, 300, size)

    def postings(share):
        places = np.flatnonzero(r.random(size) < share)
        tf = r.integers(1, 4, len(places))
        packed = [x.astype("<u4").tobytes() for x in (places, tf, dl[places])]
        return lexical.postings_of(*packed, int(tf.max()), float((dl[places] / tf).min()), 175.0)

    lists = [postings(s) for s in (0.9, 0.8, 0.95, 0.003, 0.004, 0.7)]
    weights = np.array([0.1, 0.2, 0.05, 6.0, 5.5, 0.3])
    places, scores, scored = lexical.best(lists, weights, size, 10, np.zeros(0, np.int64))
    total = np.zeros(size)
    for w, p in zip(weights, lists, strict=True):
        total[p.places] += w * p.adds
    want = np.lexsort((np.arange(size), -np.round(total, 9)))[:10]
    assert places.tolist() == want.tolist() and np.allclose(scores, total[want])
    assert scored < 0.01 * size < 0.9 * size < np.count_nonzero(total)
    gone = want[:3]
    assert lexical.best(lists, weights, size, 7, gone)[0].tolist() == want[3:].tolist()


# versions


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "index"), config=EngineConfig(min_k=3))


def held(engine, version=None):
    return {r["source_name"]: r["text"] for r in engine.store.table("chunks", version).collect()}


def ranks(index_, spark, *asked):
    rows = lexical.bm25_top(index_, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), 5).collect()
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in rows)


def rebuilt(engine):
    return lexical.build_index(engine.store.table("tokens").selectExpr("chunk_id AS id", "tokens"))


def test_a_change_writes_its_rows_alone(engine, spark, tmp_path):
    paths = [write(tmp_path / f"d/{k}.txt", f"paper {k} of the river and stone number{k}") for k in range(6)]
    engine.build(paths)
    before = {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "index") for f in fs}
    engine.add([write(tmp_path / "d/new.txt", "a new river of paper")])
    parts = engine.store._parts(2)
    assert len(parts) == 2 and {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "index") for f in fs} > before
    for name, n in (("sources", 1), ("chunks", 1), ("vectors", 1), ("tokens", 1), ("terms", 5)):
        assert spark.read.parquet(f"{tmp_path}/index/default/{parts[1]['dir']}/{name}").count() == n, name
    write(tmp_path / "d/2.txt", "changed words")
    engine.build([paths[2]])
    assert spark.read.parquet(f"{tmp_path}/index/default/{engine.store._parts(3)[2]['dir']}/chunks").count() == 1
    assert held(engine)["2.txt"] == "changed words" and held(engine, 2)["2.txt"].startswith("paper 2") and len(held(engine)) == 7
    assert engine.remove(path=paths[0]) == 1 and "0.txt" not in held(engine) and "0.txt" in held(engine, 3)
    engine.build([paths[0]])  # comes back after it had gone
    assert held(engine)["0.txt"].startswith("paper 0") and engine.store.version == 5


def test_stored_index_is_the_rebuilt_one(engine, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_PARTS", 4)
    r = random.Random(4)
    words = "river stone paper lamp green window seven often wander copper".split()
    there = {}
    for step in range(7):
        changed = [write(tmp_path / f"d/{k}.txt", " ".join(r.choices(words, k=r.randrange(1, 12)))) for k in r.sample(range(9), 3)]
        engine.build(changed)
        there |= {os.path.basename(p): open(p).read() for p in changed}
        if step % 3 == 1:
            gone = r.choice(sorted(there))
            engine.remove(path=str(tmp_path / "d" / gone))
            del there[gone]
        stored, plain = engine.store.lexical(), rebuilt(engine)
        assert held(engine) == there and stored.n == plain.n == len(there) and stored.avgdl == pytest.approx(plain.avgdl)
        value = lambda ix: sorted((x["term"], x["df"], round(x["idf"], 9)) for x in ix.terms.collect())
        assert value(stored) == value(plain)
        assert ranks(stored, spark, "river stone", "paper", "lamp often nowhere") == ranks(plain, spark, "river stone", "paper", "lamp often nowhere")
    assert len(engine.store._parts(engine.store.version)) <= 4
    version = engine.store.compact(engine.config)
    assert len(engine.store._parts(version)) == 1 and held(engine) == there
    assert ranks(engine.store.lexical(), spark, "river stone") == ranks(rebuilt(engine), spark, "river stone")


def test_a_question_writes_no_table(engine, spark, tmp_path):
    engine.build([write(tmp_path / "a.md", "Northern lights glow green in Norway."), write(tmp_path / "b.md", "Bread needs flour and water.")])
    engine.build_graph()
    shared, folder = shared_dir(spark).removeprefix("file:"), tmp_path / "index"
    listing = lambda: sorted(os.path.join(d, f) for top in (shared, folder) for d, _, fs in os.walk(top) for f in fs)
    before = listing()
    engine.answer("Where do lights glow")
    engine.answer("Norway", use_graph=True)
    engine.retrieve("flour").collect()
    assert listing() == before
    engine.add([write(tmp_path / "c.md", "Copper lamps.")])
    assert [p for p in listing() if p.startswith(shared) and p not in before] == []  # a change leaves nothing but its part


def test_tables_of_a_query_go_with_their_block(spark, sf):
    from skeinwork.plans import retrieval

    shared = shared_dir(spark).removeprefix("file:")
    before = sorted(os.listdir(shared))
    with scratch(spark):
        assert retrieval.bm25_top10(spark, sf).count() == 10
        assert sorted(os.listdir(shared)) != before
    assert sorted(os.listdir(shared)) == before


def test_damaged_log_entries_and_graphs_are_passed_over(engine, tmp_path):
    engine.build([write(tmp_path / "a.md", "Northern lights glow green in Norway. Northern Norway.")])
    with open(tmp_path / "index/default/log/00000002.json", "w") as f:
        f.write("{")
    with open(tmp_path / "index/default/log/00000003.json", "w") as f:
        json.dump({"version": 3, "parts": "none"}, f)
    assert engine.store.version == 1 and engine.build([write(tmp_path / "b.md", "Bread")]) == 4
    os.makedirs(tmp_path / "index/default/graphs", exist_ok=True)
    with open(tmp_path / "index/default/graphs/00000004.json", "w") as f:
        f.write("[")
    assert not engine.store.has("edges") and engine.store.table("edges").count() == 0
    with pytest.raises(ValueError):
        engine.store.load_graph()
