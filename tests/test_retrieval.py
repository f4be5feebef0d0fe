import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinwork.functions.text import tokenize
from skeinwork.operators import fusion, graph, lexical, quality, vector
from skeinwork.plans import catalogue, retrieval


def index(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return lexical.build_index(lexical.tokens_of(df, "id"))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_bm25_ranks_chunks_without_a_term(spark):
    ix = index(spark, ["red fox", "blue", None, "red red sun", "green"])
    got = [(r["id"], r["score"]) for r in lexical.bm25_top(ix, queries(spark, "red red"), 4).orderBy("rank").collect()]
    assert [g[0] for g in got] == [3, 0, 1, 2] and got[2][1] == got[3][1] == 0
    idf = math.log(5 - 2 + 0.5) - math.log(2.5)
    assert got[0][1] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.4)), abs=1e-8)


def test_bm25_negative_idf_is_floored_and_empty_corpus(spark):
    terms = {r["term"]: r["idf"] for r in index(spark, ["a b", "a c", "a d"]).terms.collect()}
    assert terms["a"] == pytest.approx(0.25 * (3 * (math.log(2.5) - math.log(1.5)) + math.log(0.5) - math.log(3.5)) / 4)
    assert lexical.bm25_top(index(spark, []), queries(spark, "a"), 3).count() == 0
    assert [r["score"] for r in lexical.bm25_top(index(spark, ["", ""]), queries(spark, "a"), 3).collect()] == [0.0, 0.0]


def test_token_reuse(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "new")], "chunk_id string, text string")
    old = spark.createDataFrame([("a", None, ["kept"]), ("b", "other", ["old"])], "chunk_id string, document_hash string, tokens array<string>").withColumn("document_hash", F.coalesce("document_hash", F.sha2(F.lit("one two"), 256)))
    assert {r["id"]: (r["tokens"], r["reused"]) for r in lexical.reuse_tokens(docs, old).collect()} == {"a": (["kept"], True), "b": (["new"], False)}


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 0.0])], "id long, embedding array<float>")
    q = v.filter("id = 1").select(F.col("id").alias("query_id"), "embedding")
    assert [(r["id"], r["dist"]) for r in vector.nearest(v, q, 3).orderBy("rank").collect()] == [(1, 0.0), (4, 0.0), (3, pytest.approx(1 - 1 / math.sqrt(2)))]
    assert [r["id"] for r in vector.nearest_one(v, [1.0, 0.0], 4).orderBy("rank").collect()] == [1, 4, 3, 2]
    assert vector.nearest(v, q.limit(0), 3).count() == 0
    assert vector.dimension_of(v) == 2
    with pytest.raises(ValueError):
        vector.dimension_of(v.unionByName(spark.createDataFrame([(9, [1.0])], v.schema)))


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id string, score double, rank int")


def test_fusion_ties_and_anchor(spark):
    sem = ranked(spark, [(0, "b", 0.0, 1), (0, "a", 0.0, 2)])
    lex = ranked(spark, [(0, "a", 0.0, 1), (0, "c", 0.0, 2)])
    rows = fusion.reciprocal_ranks(sem, lex).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "b", "c"] and rows[0]["score"] == pytest.approx(1 / 31 + 1 / 30)
    anchors = spark.createDataFrame([("c",)], "id string")
    assert fusion.reciprocal_ranks(sem, lex, anchors=anchors).orderBy("rank").first()["id"] in ("a", "c")
    assert fusion.reciprocal_ranks(sem, lex, anchors=anchors).filter("id = 'c'").first()["score"] == pytest.approx(2 / 31)


@pytest.mark.parametrize(
    ("scores", "low", "high", "k"),
    [([9.0, 8.0], 3, 5, 2), ([1.0] * 10, 3, 5, 5), ([9.0, 8.0, 7.0, 1.0, 0.9], 3, 20, 3), ([9.0, 8.9, 8.8, 8.0, 7.2, 1.0], 3, 5, 3), ([5.0, 4.0, 3.0, 3.0, 3.0], 3, 20, 5)],
)
def test_dynamic_top_k(spark, scores, low, high, k):
    df = ranked(spark, [(0, str(i), s, i + 1) for i, s in enumerate(scores)])
    assert fusion.dynamic_top_k(df, low, high).first()["k"] == k


def test_refusals_and_merge(spark):
    r = ranked(spark, [(0, "a", 0.001, 1), (1, "a", 0.5, 1)])
    assert {x["query_id"]: x["refused"] for x in fusion.refusals(queries(spark, "x", "y", "z"), r).collect()} == {0: True, 1: False, 2: True}
    parents = spark.createDataFrame([(0, 7), (1, 7)], "query_id long, parent_id long")
    assert [tuple(x) for x in fusion.merge_sub_queries(r, parents).collect()] == [(7, "a", 0.5, 1)]


def lists(spark, rows):
    return spark.createDataFrame(rows, "id string, entities array<string>")


def weights(df):
    return {(r["u"], r["v"]): r["weight"] for r in df.collect()}


def test_graph_edges(spark):
    assert weights(graph.edges(lists(spark, [("c1", ["A", "B", "C"]), ("c2", ["A", "B"]), ("c3", ["A", "D"])]))) == {("A", "B"): 2}
    many = lists(spark, [("c", [f"E{i:02d}" for i in range(25)])])
    assert graph.edges(many, 1, 10).count() == 45 and graph.mentions(many).count() == 25
    assert weights(graph.edges(lists(spark, [("1", ["A", "B", "C"]), ("2", ["A", "B", "C"]), ("3", ["A", "B"])]), 1)) == {("A", "B"): 3, ("A", "C"): 2, ("B", "C"): 2}
    assert graph.edges(lists(spark, []), 1).count() == 0
    single = lists(spark, [("1", ["X"]), ("2", ["X", "X"])])
    assert graph.edges(single, 1).count() == 0 and graph.mentions(single).count() == 2


def test_related(spark):
    e = spark.createDataFrame([("A", "B", 6), ("B", "C", 3), ("A", "D", 2)], "u string, v string, weight long")
    seeds = spark.createDataFrame([(0, "a"), (0, "none")], "query_id long, entity string")
    assert [(r["entity"], r["score"]) for r in graph.related(e, seeds).orderBy("rank").collect()] == [("B", 3.0), ("A", 2.0), ("D", 1.0)]
    assert [(r["entity"], r["score"]) for r in graph.related(e, seeds, 2).orderBy("rank").collect()] == [("B", 3.0), ("A", 2.0), ("C", 1.0), ("D", 1.0)]
    m = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y")], "entity string, id string")
    assert [(r["id"], r["hits"]) for r in graph.chunks_by_entities(graph.related(e, seeds), m).orderBy("rank").collect()] == [("x", 2), ("y", 1)]


def test_quality(spark):
    q = queries(spark, "a", "b", "c")
    r = ranked(spark, [(0, "x", 0.0, 1), (0, "y", 0.0, 2), (1, "z", 0.0, 1)]).drop("score")
    rel = spark.createDataFrame([(0, "y"), (0, "w"), (1, "q")], "query_id long, id string")
    got = {x["query_id"]: (x["recall"], x["reciprocal_rank"], x["ndcg"]) for x in quality.per_query(q, r, rel, 3).collect()}
    assert got[0] == (0.5, 0.5, pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))) and got[1] == (0, 0, 0) and got[2] == (1, 1, 1)
    m = quality.means(quality.per_query(q.limit(0), r, rel, 3))
    assert m.first()["recall"] == 0
    with pytest.raises(AssertionError):
        quality.assert_gates(m, {"mrr": 0.5})


def test_smoke_benchmark_meets_the_gates(spark):
    corpus = {"mobility-0": "human mobility prediction with language models", "privacy-0": "privacy of location data in local storage", "graph-0": "knowledge graph retrieval with entities"}
    cases = spark.createDataFrame([("1", "mobility prediction", ["mobility-0"]), ("2", "location privacy", ["privacy-0"]), ("3", "entity knowledge graph", ["graph-0"])], "query_id string, query string, relevant array<string>")
    df = spark.createDataFrame(list(corpus.items()), "id string, text string")
    ix = lexical.build_index(lexical.tokens_of(df, "id"))
    metrics = quality.run_benchmark(cases, lambda q: lexical.bm25_top(ix, q, 3).select("query_id", "id", "rank"), 3)
    quality.assert_gates(metrics, {"recall": 1.0, "mrr": 0.8, "ndcg": 0.8})


def test_nearest_takes_queries_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 7), 1.0]) for i in range(40)], "id int, embedding array<float>").repartition(3)
    q = v.select(F.col("id").alias("query_id"), "embedding")
    whole = sorted(vector.nearest(v, q, 3).collect())
    monkeypatch.setattr(vector, "MAX_QUERIES", 7)
    monkeypatch.setattr(vector, "CELLS", 50)
    assert sorted(vector.nearest(v, q, 3).collect()) == whole and len(whole) == 120


def test_vector_batch_topk_asks_every_twentieth_vector(spark, sf):
    got = sorted(tuple(r) for r in retrieval.vector_batch_topk(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    # the query's SQL with every query vector that the job has
    want = sorted(con.execute(retrieval.ORACLES["vector_batch_topk"].replace("id < 20", "id % 20 = 0")).fetchall())
    assert {r[0] for r in got} == {x for (x,) in con.execute("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
    assert [(q, i, rank) for q, i, _, rank in got] == [(q, i, rank) for q, i, _, rank in want]
    assert [d for _, _, d, _ in got] == pytest.approx([d for _, _, d, _ in want], abs=2e-6)


def test_should_decompose_reads_whole_texts(spark, tmp_path):
    long = {(1, 0): "Why is the sky blue?", (1, 1): "abcdefgh ij", (2, 0): "abcdefg漢", (2, 1): "abcdefghij", (3, 0): "a b", (3, 1): None}
    spark.createDataFrame([(c, t, "user", x) for (c, t), x in long.items()], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["id"]: r["decompose"] for r in retrieval.should_decompose_texts(spark, str(tmp_path)).collect()}
    assert got == {"b7": True, "c1-0": True, "c1-1": True, "c2-0": True, "c2-1": False, "c3-0": False, "c3-1": False}


def test_holders_of_queries(spark):
    texts = ["the quick brown fox jumps", "a quick brown fox", None, "", "quick", "unquick brownish", "the quick  brown fox"]
    asked = ["quick brown fox", "quick", "brown", "k b", "the quick brown", "zebra of stone", "quick  brown", " ", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {(r["query_id"], r["id"]) for r in quality.holders(docs, queries).collect()}
    assert got == {(q, i) for q, x in enumerate(asked) for i, t in enumerate(texts) if t is not None and x in t}
    assert quality.holders(docs.limit(0), queries).count() == 0 and quality.holders(docs, queries.limit(0)).count() == 0


def test_no_products_in_ranking_plans(spark, sf):
    for name in ("bm25_batch_top10", "recall_mrr_ndcg"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_extraction_by_a_model(spark):
    def ask(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("down")
        return "\n".join(f"---段落{k + 1}---\n- {t[:5]} {len(t)}" for k, t in enumerate(texts))

    rows = spark.createDataFrame([(1, "alpha"), (2, None), (3, "alpha"), (4, "b" * 2000), (5, "fail now")], "id long, text string").coalesce(1)
    got = {r["id"]: r["entities"] for r in graph.extract_with(rows, "id", ask, size=1).collect()}
    assert got == {1: ["alpha 5"], 2: [], 3: ["alpha 5"], 4: ["bbbbb 1500"], 5: []}
    assert graph.extract_with(rows.limit(0), "id", ask).count() == 0


def test_steps_follow_bytes_and_not_batches(spark, monkeypatch):
    """One batch of many rows is made into several segments, its texts are embedded by runs, and its lists unpacked by runs."""
    monkeypatch.setattr(lexical, "SEGMENT_TOKENS", 50)
    monkeypatch.setattr(lexical, "LIST_BYTES", 100)
    monkeypatch.setattr(vector, "TEXT_BYTES", 64)
    rng = random.Random(5)
    texts = [(k, None if k % 17 == 3 else " ".join(rng.choice(["red", "blue", "green", f"w{k % 9}"]) for _ in range(rng.choice([0, 3, 9, 70])))) for k in range(60)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    cut = lexical.build_index(df.select("id", tokenize("text").alias("tokens")))
    held = cut.segments.filter("term IS NULL").select("segment", "df", F.expr("aggregate(lengths, 0L, (s, v) -> s + v)").alias("n")).collect()
    assert len(held) > 5 and all(r["n"] <= 50 or r["df"] == 1 for r in held) and sum(r["df"] for r in held) == 60
    monkeypatch.setattr(lexical, "SEGMENT_TOKENS", 1 << 21)
    whole = lexical.build_index(df.select("id", tokenize("text").alias("tokens")))
    asked = spark.createDataFrame([(1, "red w1 w2"), (2, "blue"), (3, "none")], "query_id long, query string")
    assert sorted(map(tuple, lexical.bm25_top(cut, asked, 20).collect())) == sorted(map(tuple, lexical.bm25_top(whole, asked, 20).collect()))

    class Few(vector.HashingEmbedder):
        def encode(self, some):
            assert len(some) == 1 or sum(len(t.encode()) for t in some) <= 64
            return super().encode(some)

    got = dict(vector.embed(df, Few()).select("id", "embedding").collect())
    want = vector.HashingEmbedder().encode([t for _, t in texts])
    assert all(got[k] == want[k].tolist() for k in range(60))
