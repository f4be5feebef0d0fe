"""Entity co-occurrence graph: build, expansion, and chunks by entity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import entities, parse_entity_response
from .lexical import DIGITS, top_per_query

#: Texts that a model is asked about at once, and the characters of each that it sees.
BATCH, PROMPT_CHARS = 5, 1500
#: Items of a group whose pairs with another such block are formed in one row.
PAIR_BLOCK = 256
#: Rows, pairs, and lists of entities that a task has at once: what an aggregate or a sort of them holds follows these and not the input.
ROWS_EACH, PAIRS_EACH, LISTS_EACH = 1 << 18, 1 << 20, 1 << 13


def extract(chunks: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, entities): the offline extractor."""
    return chunks.select(F.col(id_column).alias("id"), entities(text).alias("entities"))


def extract_with(chunks: DataFrame, id_column: str, ask: Callable[[list[str]], str], text: str = "text", size: int = BATCH, cache: str | None = None) -> DataFrame:
    """(id, entities) by a model: ``ask`` gets the first PROMPT_CHARS characters of up to ``size`` texts and answers with lines.

    Each distinct text is asked for once. A call that fails leaves the texts of its batch without entities, and so are null
    texts. ``ask`` runs in the workers, so it must be picklable. With ``cache``, a folder for one model, answers are kept by the
    digest of the text and looked up first, in this call and in later ones; failed batches are asked for again next time.
    """
    keyed = chunks.select(F.col(id_column).alias("id"), F.sha2(F.col(text), 256).alias("key"), F.substring(F.col(text), 1, PROMPT_CHARS).alias("prompt"))
    wanted = keyed.filter("prompt IS NOT NULL").groupBy("key").agg(F.first("prompt").alias("prompt"))
    if cache is None:
        found = _answered(wanted, ask, size)
    else:
        missing = wanted.join(cached(chunks.sparkSession, cache), "key", "left_anti")
        _answered(missing, ask, size).filter("entities IS NOT NULL").write.mode("append").parquet(cache)
        found = cached(chunks.sparkSession, cache)
    return keyed.join(found, "key", "left").select("id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """(key, entities) of all texts that were asked for; two writers may both have asked for one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _ANSWERS)
    return spark.read.schema(_ANSWERS).parquet(cache).dropDuplicates(["key"])


_ANSWERS = "key string, entities array<string>"


def _answered(wanted: DataFrame, ask: Callable[[list[str]], str], size: int) -> DataFrame:
    """(key, entities) of (key, prompt); no entities where the call failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, prompts = b.column("key").to_pylist(), b.column("prompt").to_pylist()
            rows: list[tuple] = []
            for lo in range(0, len(keys), size):
                part = prompts[lo : lo + size]
                try:
                    answer = ask(part)
                except Exception:  # noqa: BLE001
                    answer = None
                rows += [(keys[lo + k], k, len(part), answer) for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["key", "place", "n", "answer"])

    asked = wanted.mapInArrow(run, "key string, place int, n int, answer string")
    parsed = F.coalesce(F.get(parse_entity_response("answer", F.col("n")), F.col("place")), F.array().cast("array<string>"))
    return asked.select("key", F.when(F.col("answer").isNotNull(), parsed).alias("entities"))


def mentions(lists: DataFrame) -> DataFrame:
    """(entity, id): all distinct entities of each chunk, whatever their number."""
    return lists.select("id", F.explode(F.array_distinct("entities")).alias("entity")).select("entity", "id")


def edges(lists: DataFrame, min_cooccur: int = 2, max_entities: int = 20, count: int | None = None) -> DataFrame:
    """(u, v, weight), u < v: in how many chunks both are among the first ``max_entities``.

    With ``count``, the number of lists where it is known, they are dealt anew, a bounded number to each task.
    """
    if count is not None:
        lists = lists.repartition(_parts(count, LISTS_EACH), "id")
    return _pairs(lists, max_entities).groupBy("u", "v").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_cooccur)


def _parts(n: int, each: int) -> int:
    return max(1, ceil(n / each))


def _pairs(lists: DataFrame, max_entities: int) -> DataFrame:
    """(u, v) of each chunk: formed within its row (at most max_entities squared halves), so nothing is joined."""
    few = lists.select(F.slice(F.array_distinct("entities"), 1, max_entities).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice(F.col("e"), i + 2, max_entities), lambda b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")))))
    return few.select(F.explode(pairs).alias("p")).select("p.u", "p.v")


def merged_pairs(old: DataFrame, added: DataFrame, removed: DataFrame, max_entities: int = 20) -> DataFrame:
    """(u, v, weight) of all pairs after chunks came and went: the pairs of their lists, with a sign, are added to the old ones.

    ``old`` has the pairs of every weight; those that no chunk has any more are left out.
    """
    signed = _pairs(added, max_entities).withColumn("weight", F.lit(1)).unionByName(_pairs(removed, max_entities).withColumn("weight", F.lit(-1)))
    both = old.select("u", "v", F.col("weight").cast("long")).unionByName(signed.withColumn("weight", F.col("weight").cast("long")))
    return both.groupBy("u", "v").agg(F.sum("weight").alias("weight")).filter("weight > 0")


def pair_counts(rows: DataFrame, group: str, item: str, least: int = 2, block: int = PAIR_BLOCK) -> DataFrame:
    """(u, v, weight) of items that share a group in ``least`` groups or more, from plain rows.

    A group's items are dealt into blocks of about ``block``, and pairs are formed between two blocks at a time, so that no row
    holds more than about ``block`` squared of them, however large the group. Rows and pairs are dealt to as many tasks as keep
    each at about ROWS_EACH and PAIRS_EACH; hardly any pair comes twice in a task, so they are only counted where they are dealt to.
    """
    found = pair_blocks(rows, group, item, block)
    sizes = _dealt(rows, group, item).groupBy("group").agg(F.count("*").alias("n"))
    many = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    own = F.col("i") == F.col("j")
    pairs = F.flatten(F.transform("x", lambda a: F.transform(F.filter("y", lambda b: ~own | (a < b)), lambda b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")))))
    dealt = found.select(F.explode(pairs).alias("p")).select("p.u", "p.v").repartition(_parts(many, PAIRS_EACH), "u", "v")
    return dealt.groupBy("u", "v").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def _dealt(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item) without nulls, a group's rows in one task."""
    items = rows.select(F.col(group).alias("group"), F.col(item).alias("item"))
    return items.filter("group IS NOT NULL AND item IS NOT NULL").repartition(_parts(rows.count(), ROWS_EACH), "group")


def pair_blocks(rows: DataFrame, group: str, item: str, block: int = PAIR_BLOCK) -> DataFrame:
    """(group, i, j, x, y): two blocks of a group's distinct items, i <= j. Pairs of groups of one block need no join."""
    size = F.count("*").over(Window.partitionBy("group"))
    dealt = _dealt(rows, group, item).withColumn("blocks", F.ceil(size / block).cast("int"))
    lists = dealt.groupBy("group", "blocks", F.pmod(F.xxhash64("item"), "blocks").cast("int").alias("i")).agg(F.collect_set("item").alias("x"))
    alone = lists.select("group", "i", F.col("i").alias("j"), "x", F.col("x").alias("y"))
    many = lists.filter("blocks > 1")
    met = many.select("group", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"), "x").filter("i < j")
    return alone.unionByName(met.join(many.select("group", F.col("i").alias("j"), F.col("x").alias("y")), ["group", "j"]).select("group", "i", "j", "x", "y"))


def nodes(edge_table: DataFrame) -> DataFrame:
    """(entity) of the ends of edges."""
    return edge_table.select(F.explode(F.array("u", "v")).alias("entity")).distinct()


def degrees(edge_table: DataFrame) -> DataFrame:
    """(entity, degree, strength)."""
    ends = edge_table.select(F.explode(F.array("u", "v")).alias("entity"), "weight")
    return ends.groupBy("entity").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def related(edge_table: DataFrame, seeds: DataFrame, max_hops: int = 1, top_k: int = 10) -> DataFrame:
    """(query_id, entity, score, rank) from (query_id, entity) as asked for, in any case.

    Seeds that are nodes score 2; a node first reached in hop h (from 0) scores its heaviest edge to the frontier / (h + 2).
    From the second hop on a query may reach most nodes: the rows of such a hop are counted first, by degrees, and nodes are dealt to
    as many tasks as keep each at about PAIRS_EACH of them.
    """
    both = edge_table.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight")
    both = both.unionByName(edge_table.select(F.col("v").alias("a"), F.col("u").alias("b"), "weight"))
    named = nodes(edge_table).groupBy(F.lower("entity").alias("low")).agg(F.max("entity").alias("entity"))
    start = seeds.select("query_id", F.lower("entity").alias("low")).distinct().join(named, "low").select("query_id", "entity")
    seen = start.select("query_id", "entity", F.lit(2.0).alias("score"))
    frontier = start
    for hop in range(max_hops):
        if hop:
            work = frontier.join(degrees(edge_table), "entity").agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
            frontier, both = (side.repartition(_parts(work, PAIRS_EACH), key) for side, key in ((frontier, "entity"), (both, "a")))
        reached = frontier.join(both, frontier["entity"] == both["a"]).groupBy("query_id", F.col("b").alias("entity")).agg((F.max("weight") / (hop + 2)).alias("score"))
        fresh = reached.join(seen.select("query_id", "entity"), ["query_id", "entity"], "left_anti")
        seen = seen.unionByName(fresh)
        frontier = fresh.select("query_id", "entity")
    return top_per_query(seen.withColumn("score", F.round("score", DIGITS)), top_k, F.desc("score"), F.asc("entity"))


def chunks_by_entities(found: DataFrame, mention_table: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, id, hits, rank): chunks with the most of each query's entities."""
    hits = found.select("query_id", "entity").join(mention_table, "entity").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    return top_per_query(hits, most, F.desc("hits"), F.asc("id"))


def stats(edge_table: DataFrame, mention_table: DataFrame) -> DataFrame:
    """One row: number of nodes, edges, mentioned entities and chunks."""
    n = nodes(edge_table).agg(F.count("*").alias("nodes"))
    e = edge_table.agg(F.count("*").alias("edges"))
    m = mention_table.agg(F.count_distinct("entity").alias("entities"), F.count_distinct("id").alias("chunks"))
    return n.crossJoin(e).crossJoin(m)
