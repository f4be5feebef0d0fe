"""Inverted index in segments, and pruned BM25 ranking.

A segment holds the postings of a bounded number of chunks: a row for each of its terms with the chunks' places, frequencies
and lengths as packed arrays, and what bounds the term's score there (the highest frequency, the least length per occurrence).
A hot term is so split over all segments. One more row, without a term, lists the chunks' ids in order, so that a smaller
place is a smaller id. Segments are only ever added; numbers of chunks by term are sums over them.

Ranking sends a block of queries to all segments. Only the lists of asked terms are read, and dealt by segment. There the
lists of a query go from the highest bound to the lowest (MaxScore): once the lists that are left cannot lift a new chunk
among the best k, they are only looked up for the chunks that are still in question. Each segment leaves k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokenize
from .store import runs, spread, union, written

K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 9  # ranks go by scores rounded to so many digits, so that sums in another order don't change them
#: Most chunks and about the most tokens of a segment, queries that are sent at once, and terms that a scan is asked for by name.
SEGMENT_CHUNKS, SEGMENT_TOKENS, MAX_QUERIES, MOST_NAMED = 1 << 16, 1 << 21, 5_000, 1_000
#: Bytes of posting lists that a task unpacks at once.
LIST_BYTES = 1 << 22
#: Rows of rankings that are sent to all tasks to find their ids; more are joined in a shuffle.
MOST_SENT = 1 << 20
#: Sums in another order differ by less than this.
SLACK = 1e-9


def segment_schema(id_type: T.DataType) -> T.StructType:
    kinds = {"segment": T.StringType(), "term": T.StringType(), "df": T.LongType(), "max_tf": T.LongType(), "least_ratio": T.DoubleType(), "places": T.BinaryType(), "tfs": T.BinaryType(), "dls": T.BinaryType(), "ids": T.ArrayType(id_type), "lengths": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


@dataclass(frozen=True)
class LexicalIndex:
    """``segments`` as ``build_segments`` makes them, ``totals`` (term, df, max_tf, least_ratio) over all of them, the number of
    chunks, their mean length, the mean of all terms' raw idf, and places (segment, place) of chunks that have gone since."""

    segments: DataFrame
    totals: DataFrame
    n: int
    avgdl: float | None
    mean: float | None
    gone: DataFrame | None = None
    count: int | None = None  # of segments, where it is known

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf): negative values are replaced by EPSILON times the mean of all."""
        return self.totals.select("term", "df", idf(raw_idf(self.n, F.col("df")), self.mean).alias("idf"))

    @property
    def places(self) -> DataFrame:
        """(segment, place, id, dl) of the chunks that are there."""
        listed = self.segments.filter("term IS NULL").select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "c"))
        listed = listed.select("segment", "place", F.col("c.ids").alias("id"), F.col("c.lengths").alias("dl"))
        return listed.join(self.gone, ["segment", "place"], "left_anti") if self.gone is not None else listed

    @property
    def lengths(self) -> DataFrame:
        return self.places.select("id", "dl")

    @property
    def ids(self) -> DataFrame:
        return self.places.select("id")


def raw_idf(n: int, df: Column) -> Column:
    return F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)


def idf(raw: Column, mean: float | None) -> Column:
    return F.when(raw >= 0, raw).otherwise(F.lit(EPSILON) * F.lit(mean).cast("double"))


def tokens_of(chunks: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    return spread(chunks.select(F.col(id_column).alias("id"), F.col(text).alias("text"))).select("id", tokenize("text").alias("tokens"))


def reuse_tokens(chunks: DataFrame, previous: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """(id, document_hash, tokens, reused): tokens of the previous index where id and text hash agree, else made anew."""
    now = chunks.select(F.col(id_column).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_hash"), "text")
    old = previous.select(F.col(id_column).alias("id"), "document_hash", F.col("tokens").alias("old"))
    joined = now.join(old, ["id", "document_hash"], "left")
    return joined.select("id", "document_hash", F.coalesce("old", tokenize("text")).alias("tokens"), F.col("old").isNotNull().alias("reused"))


def build_segments(tokens: DataFrame, prefix: str = "", chunks: int = SEGMENT_CHUNKS) -> DataFrame:
    """The segments of (id, tokens), each from one partition. Chunks without tokens are listed and have no postings. A segment has
    at most SEGMENT_TOKENS tokens or one longer chunk, however many a batch of rows has.

    Names are the prefix, the partition and a number, so the segments of several calls need different prefixes.
    """
    id_type = tokens.schema["id"].dataType
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, size, number = [], 0, 0, 0
        for b in batches:
            counts = pc.list_value_length(b.column(1)).fill_null(0).to_numpy()
            for first, end in runs(counts, SEGMENT_TOKENS):
                for lo in range(first, end, chunks):
                    part = b.slice(lo, min(chunks, end - lo))
                    n = int(counts[lo : lo + part.num_rows].sum())
                    if held and (many + part.num_rows > chunks or size + n > SEGMENT_TOKENS):
                        yield from _segment(held, f"{prefix}{TaskContext.get().partitionId()}.{number}", kind)
                        held, many, size, number = [], 0, 0, number + 1
                    held.append(part)
                    many, size = many + part.num_rows, size + n
        if many:
            yield from _segment(held, f"{prefix}{TaskContext.get().partitionId()}.{number}", kind)

    return tokens.select("id", "tokens").mapInArrow(run, segment_schema(id_type))


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as binaries of unsigned 32-bit integers."""
    data = np.ascontiguousarray(values, "<u4")
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(data)])


def _segment(parts: list[pa.RecordBatch], name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(parts).combine_chunks()
    parts.clear()
    table = table.take(pc.sort_indices(table, [("id", "ascending")]))
    ids, lists = table.column("id").combine_chunks().cast(kind), table.column("tokens").combine_chunks()
    dl = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    pair = rank[coded.indices.to_numpy()] * len(dl)
    pair += np.repeat(np.arange(len(dl)), dl)
    words = coded.dictionary.take(order).cast(pa.string())
    del table, lists, coded, rank
    pair.sort()
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(pair)))
    pair = pair[first]
    cuts = np.searchsorted(pair, np.arange(len(order) + 1) * len(dl))
    place = pair % max(1, len(dl))
    del pair, first
    schema = pa.schema([("segment", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("max_tf", pa.int64()), ("least_ratio", pa.float64()), ("places", pa.binary()), ("tfs", pa.binary()), ("dls", pa.binary()), ("ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64()))])
    yield pa.RecordBatch.from_pylist([{"segment": name, "df": len(dl), "ids": ids.to_pylist(), "lengths": dl}], schema)
    if len(order):
        none = lambda t: pa.nulls(len(order), t)
        ratio = np.minimum.reduceat(dl[place] / tf, cuts[:-1])
        columns = [pa.array([name] * len(order)), words, pa.array(np.diff(cuts)), pa.array(np.maximum.reduceat(tf, cuts[:-1])), pa.array(ratio), _packed(place, cuts), _packed(tf, cuts), _packed(dl[place], cuts), none(pa.list_(kind)), none(pa.list_(pa.int64()))]
        whole = pa.RecordBatch.from_arrays(columns, schema=schema)
        for lo in range(0, len(order), 4096):
            yield whole.slice(lo, 4096)


def totals_of(segments: DataFrame) -> DataFrame:
    """(term, df, max_tf, least_ratio) over all segments."""
    return segments.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("least_ratio").alias("least_ratio"))


def build_index(tokens: DataFrame) -> LexicalIndex:
    """From (id, tokens). Chunks without tokens count in the number and the mean length of chunks.

    The segments are written once, as the terms, the statistics and every ranking read them.
    """
    segments = written(build_segments(tokens), "segments")
    lists = segments.filter("term IS NULL")
    n, size, count = lists.agg(F.coalesce(F.sum("df"), F.lit(0)), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, v: s + v)), F.count("*")).first()
    totals = totals_of(segments)
    return LexicalIndex(segments, totals, n, size / n if n else None, totals.agg(F.avg(raw_idf(n, F.col("df")))).first()[0], count=count)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) from (query_id, query); repeated words count as often."""
    return queries.select("query_id", F.explode(tokenize("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def named(rows: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of some terms: by name where they are few, so that files without them are not read."""
    if len(terms) <= MOST_NAMED:
        return rows.filter(F.col("term").isin(terms))
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))), "term", "left_semi")


@dataclass(frozen=True)
class Asked:
    """A block of queries: the ids of all, the terms that are known, and for each query numbers of terms and their weights."""

    ids: pa.Array
    terms: list[str]
    queries: list[tuple[np.ndarray, np.ndarray]]


def ask(index: LexicalIndex, queries: DataFrame) -> Asked:
    """Brings a block of queries to the driver, with the idf of their words; words that no chunk has are left out."""
    ids = queries.select("query_id").distinct().toArrow().column(0).combine_chunks()
    words = query_terms(queries).toArrow()
    term = words.column("term").combine_chunks().dictionary_encode()
    known = named(index.totals.select("term", "df"), term.dictionary.to_pylist()).select("term", idf(raw_idf(index.n, F.col("df")), index.mean).alias("idf")).toArrow()
    number = pc.index_in(term.dictionary, value_set=known.column("term").combine_chunks()).fill_null(-1).to_numpy()[term.indices.to_numpy()]
    value = known.column("idf").to_numpy()
    query = pc.index_in(words.column("query_id").combine_chunks(), value_set=ids).to_numpy()
    times = words.column("times").to_numpy()
    use = np.flatnonzero(number >= 0)
    use = use[np.argsort(query[use], kind="stable")]
    cuts = np.searchsorted(query[use], np.arange(len(ids) + 1))
    rows = [use[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    return Asked(ids, known.column("term").to_pylist(), [(number[r], times[r] * value[number[r]]) for r in rows])


@dataclass
class Postings:
    """The list of a term in a segment: places in order, what each adds for a weight of 1, and the most that any does."""

    places: np.ndarray
    adds: np.ndarray
    bound: float


def postings_of(places: bytes, tfs: bytes, dls: bytes, max_tf: int, least_ratio: float, avgdl: float) -> Postings:
    tf, dl = np.frombuffer(tfs, "<u4").astype(np.float64), np.frombuffer(dls, "<u4")
    adds = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    return Postings(np.frombuffer(places, "<u4").astype(np.int64), adds, (K1 + 1) / (1 + K1 * ((1 - B) / max_tf + B * least_ratio / avgdl)))


def best(lists: list[Postings], weights: np.ndarray, size: int, k: int, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, rounded scores, chunks scored) of the best k chunks of a segment with a positive score; weights are not negative."""
    order = np.argsort([-w * p.bound for w, p in zip(weights, lists, strict=True)], kind="stable")
    left = np.append(np.cumsum([weights[i] * lists[i].bound for i in order[::-1]])[::-1], 0.0) + SLACK
    total, least = np.zeros(size), -np.inf
    for at, i in enumerate(order):
        if left[at] < least:  # no chunk that isn't there yet can come among the best
            break
        total[lists[i].places] += weights[i] * lists[i].adds
        if len(gone):
            total[gone] = 0.0
        if left[at + 1] < left[0] - left[at + 1]:
            seen = total[total > 0]
            least = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else least
    else:
        at = len(order)
    found = np.flatnonzero(total)
    scored, score = len(found), total[found]
    for step, i in enumerate(order[at:], at):
        keep = score + left[step] >= least
        found, score = found[keep], score[keep]
        places = lists[i].places
        spot = np.minimum(np.searchsorted(places, found), len(places) - 1)
        score = score + np.where(places[spot] == found, weights[i] * lists[i].adds[spot], 0.0)
    score = np.round(score, DIGITS)
    first = np.lexsort((found, -score))[:k]
    first = first[score[first] > 0]
    return found[first], score[first], scored


def best_of_all(lists: list[Postings], weights: np.ndarray, size: int, k: int, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``best`` for weights of any sign, chunks of no or of a negative score included."""
    total = np.zeros(size)
    for w, p in zip(weights, lists, strict=True):
        total[p.places] += w * p.adds
    score, there = np.round(total, DIGITS), np.ones(size, bool)
    there[gone] = False
    found = np.flatnonzero(there)
    first = found[np.lexsort((found, -score[found]))[:k]]
    return first, score[first]


def top_per_query(scored: DataFrame, k: int, *order) -> DataFrame:
    """The first k of each query with their rank from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def _ranker(asked, avgdl: float, k: int, everything: bool):
    """Of the rows of whole segments, each segment's best k of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Asked = asked.value
        number = {t: i for i, t in enumerate(block.terms)}
        here, lists, size, gone = None, {}, 0, np.zeros(0, np.int64)

        def closed() -> Iterator[pa.RecordBatch]:
            query, place, score = [], [], []
            for q, (terms, weights) in enumerate(block.queries):
                use = [i for i, t in enumerate(terms.tolist()) if t in lists]
                if not use and not everything:
                    continue
                held = [lists[int(terms[i])] for i in use]
                p, s = (best_of_all if everything else best)(held, weights[use], size, k, gone)[:2]
                query.append(np.full(len(p), q))
                place.append(p)
                score.append(s)
            if query:
                q = block.ids.take(pa.array(np.concatenate(query)))
                yield pa.RecordBatch.from_arrays([q, pa.array([here] * len(q), pa.string()), pa.array(np.concatenate(place), pa.int32()), pa.array(np.concatenate(score))], names=["query_id", "segment", "place", "score"])

        for b in batches:
            sizes = 12 * b.column("df").fill_null(0).to_numpy()
            for r in (r for lo, hi in runs(sizes, LIST_BYTES) for r in b.slice(lo, hi - lo).to_pylist()):
                if r["segment"] != here:
                    if here is not None:
                        yield from closed()
                    here, lists, size, gone = r["segment"], {}, 0, np.zeros(0, np.int64)
                if r["gone"] is not None:
                    gone = np.array(r["gone"], np.int64)
                elif r["term"] is None:
                    size = r["df"]
                else:
                    lists[number[r["term"]]] = postings_of(r["places"], r["tfs"], r["dls"], r["max_tf"], r["least_ratio"], avgdl)
        if here is not None:
            yield from closed()

    return run


def segment_tops(index: LexicalIndex, asked: Asked, k: int, everything: bool = False) -> DataFrame:
    """(query_id, segment, place, score): the best k of every segment for each query of a block."""
    columns = ["segment", "term", "df", "max_tf", "least_ratio", "places", "tfs", "dls"]
    sizes = index.segments.filter("term IS NULL").select(*columns)
    rows = named(index.segments, asked.terms).select(*columns).unionByName(sizes).withColumn("gone", F.lit(None).cast("array<int>"))
    if index.gone is not None:
        gone = index.gone.groupBy("segment").agg(F.collect_list(F.col("place").cast("int")).alias("gone"))
        rows = rows.unionByName(gone, allowMissingColumns=True)
    sent = index.segments.sparkSession.sparkContext.broadcast(asked)
    schema = f"query_id {_sql_type(asked.ids.type)}, segment string, place int, score double"
    return rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(_ranker(sent, index.avgdl or 1.0, k, everything), schema)


def _sql_type(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()


def bm25_top(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best chunks of each query, by score and then id.

    Chunks without a query term have score 0 and rank too: the first 2k ids are added with that score, as a query has fewer than
    k better ones where it needs any. Only where some weight is negative (most terms are in most chunks), all chunks are scored.
    The queries come to the driver in blocks of about MAX_QUERIES.
    """
    spark = queries.sparkSession
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", index.segments.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    asked = queries.count()
    blocks = ceil(asked / MAX_QUERIES)
    if not blocks or not index.n:
        return spark.createDataFrame([], schema)
    scored, everything = [], (index.mean or 0.0) < 0
    for j in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == j)
        scored.append(segment_tops(index, ask(index, part), k, everything))
    hits = scored[0]
    for more in scored[1:]:
        hits = hits.unionByName(more)
    if index.count is not None and k * asked * index.count <= MOST_SENT:
        hits = F.broadcast(hits)  # so that the ids of all chunks are read where they are and not shuffled
    hits = hits.join(index.places.select("segment", "place", "id"), ["segment", "place"]).select("query_id", "id", "score")
    if not everything:
        first = index.ids.orderBy("id").limit(2 * k).toArrow().column(0).to_pylist()
        zero = queries.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(i) for i in first])).alias("id"), F.lit(0.0).alias("score"))
        hits = union(hits, zero, "query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_per_query(hits, k, F.desc("score"), F.asc("id"))
