"""The chunk index as immutable versions made of parts.

A change writes one part with its own rows alone: the sources, chunks, vectors, tokens and posting segments that are new, the
sources that have gone, and what their chunks take off the counts of terms. Then it takes the next number in a log, which only
one writer can: readers see one version, a change that fails takes no number, and of two changes to the same version the later
one fails and leaves the other alone. A version is the list of its parts; on reading, rows of a part whose source a later part
lists as gone are left out by an anti join. Beyond ``MOST_PARTS`` parts a change writes all live rows into one.

The graph of a version is stored beside it once; a new version has none until it is brought up to date.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict
from urllib.parse import quote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..config import EngineConfig
from . import graph
from .lexical import LexicalIndex, build_segments, raw_idf, reuse_tokens, segment_schema, totals_of

SCHEMA_VERSION = 2
#: Parts that a version may have before they are written anew as one.
MOST_PARTS = 16


class Conflict(RuntimeError):
    """Another writer published the version first."""


TABLES = {"sources": schemas.SOURCES, "chunks": schemas.CHUNKS, "vectors": schemas.VECTORS, "tokens": schemas.TOKENS}
GRAPH = {"edges": schemas.EDGES, "mentions": schemas.MENTIONS, "pairs": schemas.EDGES, "lists": schemas.ENTITY_LISTS}
#: Tables of a part that are no tables of the index: posting segments, signed counts of terms, places of chunks that went in
#: older segments, and sources that went from older parts.
SEGMENTS = segment_schema(T.StringType())
INNER = {"segments": SEGMENTS, "terms": T.StructType([SEGMENTS[c] for c in ("term", "df", "max_tf", "least_ratio")]), "places": T.StructType([SEGMENTS["segment"], T.StructField("place", T.IntegerType())]), "gone": T.StructType([T.StructField("source_id", T.StringType())])}
RECORDS = {"errors": schemas.ERRORS, "progress": schemas.PROGRESS}
_PART, _OWNER = T.StructField("part", T.LongType()), T.StructField("source_id", T.StringType())


def fingerprint(config: EngineConfig) -> str:
    """Of what a change of must rebuild the index."""
    kept = {"embedding_model": config.embedding_model, "embedding_dimension": config.embedding_dimension, "chunking": {k: asdict(v) for k, v in config.chunking.items()}, "schema": SCHEMA_VERSION}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def without_sources(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose source is in ``gone`` neither by id nor by path: two anti joins, as one with OR would compare all pairs."""
    by_id = rows.join(gone.select("source_id").filter("source_id IS NOT NULL").distinct(), "source_id", "left_anti")
    return by_id.join(gone.select("source_path").filter("source_path IS NOT NULL").distinct(), "source_path", "left_anti").select(*rows.columns)


def replace_sources(old: DataFrame, new: DataFrame, affected: DataFrame) -> DataFrame:
    """Rows of unaffected sources, and all new ones."""
    return without_sources(old, affected).unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't in the new ones, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def stale_sources(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(source_id, state) of files that are new or changed against the index by content hash or path."""
    was = indexed.select("source_id", F.col("content_sha256").alias("old_hash"), F.col("source_path").alias("old_path"))
    joined = files.select("source_id", "content_sha256", "source_path").join(was, "source_id", "left")
    state = F.when(F.col("old_hash").isNull(), "new").when((F.col("old_hash") != F.col("content_sha256")) | (F.col("old_path") != F.col("source_path")), "changed")
    return joined.select("source_id", state.alias("state")).filter("state IS NOT NULL")


def manifest(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each source with its chunk ids in order; sources without chunks have an empty list."""
    ids = chunks.groupBy("source_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    return sources.join(ids, "source_id", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))


def chunks_fingerprint(rows: DataFrame) -> DataFrame:
    """One row: sha256 of the sorted chunk ids and hashes as a JSON array of objects with their keys in order.

    A digest of one string has one reader, but it holds no more than a batch: lines are sorted on disk where they are many and
    hashed as they pass. Rows with a null id or hash have the word null there; an empty table gives the digest of an empty array.
    """
    line = F.format_string('{"chunk_id": "%s", "content_sha256": "%s"}', "chunk_id", "content_sha256").alias("line")
    opening = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("line"))  # so that there is a row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, before = hashlib.sha256(b"["), b""
        for b in batches:
            for text in b.column(0).drop_null().to_pylist():
                digest.update(before + text.encode())
                before = b", "
        digest.update(b"]")
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["fingerprint"])

    return rows.select(line).unionByName(opening).repartition(1).sortWithinPartitions("line").mapInArrow(run, "fingerprint string")


class IndexStore:
    """Versions of one collection below a directory of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._entries: dict[int, dict] = {}

    def _read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _swap(self, path: str, text: str) -> None:
        """Writes beside and moves it in place whole; Conflict where that place is taken."""
        temp = self._path(f"{path}.{uuid.uuid4().hex}.temp")
        out = self._fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        rename = gateway.jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = gateway.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(temp), context.makeQualified(self._path(path)), options)
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(self._path(path)):
                raise Conflict(path) from e
            raise

    def _numbers(self) -> list[int]:
        """Numbers in the log, the last first."""
        log = self._path(f"{self.path}/log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)

    def _entry(self, version: int) -> dict | None:
        """{version, fingerprint, parts, lexical} of a version, or None where it can't be read; entries never change."""
        if version not in self._entries:
            try:
                found = json.loads(self._read_text(f"{self.path}/log/{version:08d}.json"))
            except (ValueError, Py4JJavaError):
                return None
            if not (isinstance(found, dict) and found.get("version") == version and isinstance(found.get("parts"), list)):
                return None
            self._entries[version] = found
        return self._entries[version]

    def pointer(self) -> dict | None:
        """The entry of the published version, or None where there is none that can be read."""
        return next((e for e in map(self._entry, self._numbers()) if e), None)

    @property
    def version(self) -> int:
        return (self.pointer() or {}).get("version", 0)

    def exists(self) -> bool:
        return self.pointer() is not None

    def matches(self, config: EngineConfig) -> bool:
        return (self.pointer() or {}).get("fingerprint") == fingerprint(config)

    def _parts(self, version: int) -> list[dict]:
        """The parts of a version, oldest first: directory, number, and whether it has sources that went."""
        entry = self._entry(version) if version else None
        return entry["parts"] if entry else []

    def _read(self, name: str, schema: T.StructType, parts: list[dict]) -> DataFrame:
        """Rows of a table in some parts, with the part's number."""
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, _PART]))
        return self.spark.read.schema(T.StructType([*schema.fields, _PART])).parquet(*[f"{self.path}/{p['dir']}/{name}" for p in parts])

    def _live(self, name: str, parts: list[dict]) -> DataFrame:
        """Rows of a table, source_id and part with them, without those whose source a later part lists as gone."""
        schema = TABLES[name]
        rows = self._read(name, schema if "source_id" in schema.names else T.StructType([*schema.fields, _OWNER]), parts)
        if not (later := [p for p in parts if p["gone"]]):
            return rows
        gone = self._read("gone", INNER["gone"], later).groupBy("source_id").agg(F.max("part").alias("until"))
        return rows.join(gone, (rows["source_id"] == gone["source_id"]) & (rows["part"] < gone["until"]), "left_anti")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version; empty where it isn't there."""
        version = self.version if version is None else version
        if name in GRAPH:
            where = self._graph(version)
            return self.spark.read.schema(GRAPH[name]).parquet(f"{where}/{name}") if where else self.spark.createDataFrame([], GRAPH[name])
        return self._live(name, self._parts(version)).select(*TABLES[name].names)

    def has(self, name: str, version: int | None = None) -> bool:
        version = self.version if version is None else version
        return bool(self._graph(version) if name in GRAPH else self._parts(version))

    def lexical(self, version: int | None = None) -> LexicalIndex:
        """The lexical index of a version, as its parts have it: nothing is computed but sums by term, and nothing written."""
        version = self.version if version is None else version
        parts, counts = self._parts(version), (self._entry(version) or {}).get("lexical") or {"chunks": 0, "tokens": 0, "mean": None}
        gone = self._read("places", INNER["places"], later).select("segment", "place") if (later := [p for p in parts if p["gone"]]) else None
        n = counts["chunks"]
        return LexicalIndex(self._read("segments", SEGMENTS, parts).drop("part"), self._terms(parts), n, counts["tokens"] / n if n else None, counts["mean"], gone, counts.get("segments"))

    def _terms(self, parts: list[dict]) -> DataFrame:
        """Chunks by term over the parts; bounds of terms stay those of all chunks that ever had them."""
        rows = self._read("terms", INNER["terms"], parts)
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("least_ratio").alias("least_ratio")).filter("df > 0")

    def commit(self, config: EngineConfig, new: dict[str, DataFrame], gone: DataFrame, everything: bool = False) -> int:
        """Publishes a version in which the sources of ``gone`` (by id or path) are replaced by those of ``new`` (all of them if
        everything).

        ``new`` has sources, chunks and vectors, and only they are written. Tokens of chunks whose text didn't change are taken
        over. On any failure the published version stays and what was written is removed; Conflict if another writer
        published meanwhile.
        """
        numbers = self._numbers()
        old = next((v for v in numbers if self._entry(v)), 0)
        parts = [] if everything else self._parts(old)
        if len(parts) >= MOST_PARTS:
            return self._publish(config, numbers, lambda target, number: self._write_whole(target, number, parts, new, gone))
        return self._publish(config, numbers, lambda target, number: self._write_change(target, number, parts, old, new, gone, everything))

    def compact(self, config: EngineConfig) -> int:
        """Publishes a version of the same rows in one part."""
        none = {k: self.spark.createDataFrame([], TABLES[k]) for k in ("sources", "chunks", "vectors")}
        numbers = self._numbers()
        parts = self._parts(next((v for v in numbers if self._entry(v)), 0))
        return self._publish(config, numbers, lambda target, number: self._write_whole(target, number, parts, none, none["sources"].select("source_id", "source_path")))

    def _publish(self, config: EngineConfig, numbers: list[int], write: Callable[[str, int], dict]) -> int:
        number = max(numbers, default=0) + 1
        directory = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.path}/{directory}"
        self._written: dict[str, int] = {}
        try:
            made = write(target, number)
            entry = {"version": number, "fingerprint": fingerprint(config), "schema_version": SCHEMA_VERSION, "lexical": made["lexical"], "written": self._written}
            entry["parts"] = [*made["before"], {"dir": directory, "number": number, "gone": made["gone"]}]
            self._swap(f"{self.path}/log/{number:08d}.json", json.dumps(entry, sort_keys=True, indent=2))
        except BaseException:
            self._fs.delete(self._path(target), True)
            raise
        return number

    def _write(self, df: DataFrame, name: str, schema: T.StructType, target: str, number: int) -> DataFrame:
        """Writes a table of a part, counts its rows as they pass, and reads it back."""
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn("part", F.lit(number).cast("long"))
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{target}/{name}")
        self._written[name] = seen.get["rows"]
        return self._read(name, schema, [{"dir": target.removeprefix(f"{self.path}/")}])

    def _write_rows(self, target: str, number: int, new: dict[str, DataFrame], known: DataFrame) -> tuple[DataFrame, dict]:
        """The new rows of a part with their segments; ``known`` has tokens to take over. Chunks, and numbers of chunks and tokens."""
        self._write(new["sources"], "sources", TABLES["sources"], target, number)
        chunks = self._write(new["chunks"], "chunks", TABLES["chunks"], target, number)
        owner = chunks.select("chunk_id", "source_id")
        with_owner = lambda name: T.StructType([*TABLES[name].fields, _OWNER])
        self._write(new["vectors"].join(owner, "chunk_id"), "vectors", with_owner("vectors"), target, number)
        made = reuse_tokens(chunks, known).select(F.col("id").alias("chunk_id"), "document_hash", "tokens")
        tokens = self._write(made.join(owner, "chunk_id"), "tokens", with_owner("tokens"), target, number)
        segments = build_segments(tokens.select(F.col("chunk_id").alias("id"), "tokens"), f"{number}.{uuid.uuid4().hex[:8]}.")
        segments = self._write(segments.repartitionByRange("term").sortWithinPartitions("term"), "segments", SEGMENTS, target, number)
        n, size = tokens.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("tokens"), F.lit(0))), F.lit(0))).first()
        return segments, {"chunks": n, "tokens": size, "segments": segments.filter("term IS NULL").count()}

    def _write_change(self, target: str, number: int, parts: list[dict], old: int, new: dict[str, DataFrame], gone: DataFrame, everything: bool) -> dict:
        """The part of a change, and what the log needs of it."""
        ids = None
        if parts:
            sources = self._live("sources", parts).select("source_id", "source_path")
            by_id = sources.join(gone.select("source_id").distinct(), "source_id", "left_semi")
            by_path = sources.join(gone.select("source_path").distinct(), "source_path", "left_semi")
            found = self._write(by_id.select("source_id").union(by_path.select("source_id")).distinct(), "gone", INNER["gone"], target, number).select("source_id")
            ids = found if found.limit(1).count() else None
        known = self._live("tokens", parts) if ids is None else self._live("tokens", parts).join(ids, "source_id", "left_semi")
        if everything and old:
            known = self._live("tokens", self._parts(old))
        segments, counts = self._write_rows(target, number, new, known)
        terms = totals_of(segments)
        total = (self._entry(old)["lexical"] if parts else None) or {"chunks": 0, "tokens": 0, "segments": 0}
        if ids is not None:
            left = known.select(F.col("chunk_id").alias("id"), "tokens")
            words = left.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
            terms = terms.unionByName(words.select("term", (-F.col("df")).alias("df"), F.lit(None).cast("long").alias("max_tf"), F.lit(None).cast("double").alias("least_ratio")))
            places = self.lexical(old).places.join(left.select("id"), "id", "left_semi")
            self._write(places, "places", INNER["places"], target, number)
            n, size = left.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("tokens"), F.lit(0))), F.lit(0))).first()
            total |= {"chunks": total["chunks"] - n, "tokens": total["tokens"] - size}
        self._write(terms.repartitionByRange("term").sortWithinPartitions("term"), "terms", INNER["terms"], target, number)
        part = {"dir": target.removeprefix(f"{self.path}/"), "number": number, "gone": ids is not None}
        return {"before": parts, "gone": ids is not None, "lexical": self._counted([*parts, part], {k: total[k] + counts[k] for k in counts})}

    def _write_whole(self, target: str, number: int, parts: list[dict], new: dict[str, DataFrame], gone: DataFrame) -> dict:
        """A part of all live rows but those that are replaced, with the new ones."""
        whole = {k: replace_sources(self._live(k, parts).select(*TABLES[k].names), new[k], gone) for k in ("sources", "chunks")}
        kept = self._live("vectors", parts).select("chunk_id", "embedding").join(whole["chunks"].select("chunk_id"), "chunk_id", "left_semi")
        segments, counts = self._write_rows(target, number, whole | {"vectors": upsert(kept, new["vectors"], "chunk_id")}, self._live("tokens", parts))
        self._write(totals_of(segments).repartitionByRange("term").sortWithinPartitions("term"), "terms", INNER["terms"], target, number)
        return {"before": [], "gone": False, "lexical": self._counted([{"dir": target.removeprefix(f"{self.path}/"), "number": number, "gone": False}], counts)}

    def _counted(self, parts: list[dict], counts: dict) -> dict:
        """The counts with the mean raw idf of all terms, so that no question reads all of them."""
        mean = self._terms(parts).agg(F.avg(raw_idf(counts["chunks"], F.col("df")))).first()[0] if counts["chunks"] else None
        return counts | {"mean": mean}

    def prune(self, keep: int = 2) -> list[int]:
        """Takes all but the last ``keep`` versions out of the log and removes the parts and graphs that none of those needs, for
        readers that began before may still need the last ones; the versions that went. Numbers are never given again."""
        if keep < 1:
            raise ValueError("keep must be positive")
        numbers = self._numbers()
        old, kept = [v for v in numbers[keep:] if self._entry(v)], [v for v in numbers[:keep] if self._entry(v)]
        used = {p["dir"] for v in kept for p in self._parts(v)}
        for v in old:
            unused = {p["dir"] for p in self._parts(v)} - used
            out = self._fs.create(self._path(f"{self.path}/log/{v:08d}.json"), True)  # the number stays taken
            out.write(bytearray(b"null"))
            out.close()
            for directory in [f"{self.path}/{d}" for d in unused] + ([g] if (g := self._graph(v)) else []):
                self._fs.delete(self._path(directory), True)
            self._entries.pop(v)
        return sorted(old)

    def _graph_entry(self, version: int) -> dict | None:
        """{dir, base, max_entities} of the graph of a version, or None where there is none that can be read."""
        try:
            found = json.loads(self._read_text(f"{self.path}/graphs/{version:08d}.json")) if self._entry(version) else None
        except (ValueError, Py4JJavaError):
            return None
        return found if isinstance(found, dict) and isinstance(found.get("dir"), str) else None

    def _graph(self, version: int) -> str | None:
        """Where the graph of a version is."""
        entry = self._graph_entry(version)
        return entry and f"{self.path}/{entry['dir']}"

    def build_graph(self, extract: Callable[[DataFrame], DataFrame], min_cooccur: int, max_entities: int, version: int | None = None) -> None:
        """Stores the graph of a version, brought up to date from the last version before it that has one.

        ``extract`` gives (id, entities) of chunks, and is asked only for chunks whose id or text the older graph hasn't got. The
        pairs of these, and of chunks that went, are added to the stored pairs with their sign. Conflict where the version has
        a graph already.
        """
        version = self.version if version is None else version
        now = self.table("chunks", version).select("chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_hash"), "text")
        base = next((v for v in self._numbers() if v < version and (self._graph_entry(v) or {}).get("max_entities") == max_entities), None)
        old = self.table("lists", base) if base else self.spark.createDataFrame([], GRAPH["lists"])
        key = ["chunk_id", "document_hash"]
        came, stays, went = now.join(old.select(*key), key, "left_anti"), old.join(now.select(*key), key, "left_semi"), old.join(now.select(*key), key, "left_anti")
        entities = extract(came.select("chunk_id", "text")).select(F.col("id").cast("string").alias("chunk_id"), "entities")
        name = f"g{version:08d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.path}/{name}"
        try:
            added = came.select(*key).join(entities, "chunk_id").select("chunk_id", "document_hash", "entities")
            stays.select(*GRAPH["lists"].names).unionByName(added).write.parquet(f"{target}/lists")
            lists = self.spark.read.schema(GRAPH["lists"]).parquet(f"{target}/lists")
            new = lists.join(came.select(*key), key, "left_semi") if base else lists
            pairs = graph.merged_pairs(self.table("pairs", base) if base else self.spark.createDataFrame([], GRAPH["pairs"]), new, went, max_entities)
            pairs.select("u", "v", F.col("weight").cast("double")).write.parquet(f"{target}/pairs")
            self.spark.read.schema(GRAPH["pairs"]).parquet(f"{target}/pairs").filter(F.col("weight") >= min_cooccur).write.parquet(f"{target}/edges")
            graph.mentions(lists.withColumnRenamed("chunk_id", "id")).select("entity", F.col("id").alias("chunk_id")).write.parquet(f"{target}/mentions")
            self._swap(f"{self.path}/graphs/{version:08d}.json", json.dumps({"dir": name, "base": base, "max_entities": max_entities}))
        except BaseException:
            self._fs.delete(self._path(target), True)
            raise

    def load_graph(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Edges and mentions; ValueError where there are none or a weight isn't finite."""
        version = self.version if version is None else version
        if not self.has("edges", version) or not self.has("mentions", version):
            raise ValueError(f"version {version} has no graph")
        edges = self.table("edges", version)
        if edges.filter("weight IS NULL OR isnan(weight) OR weight = double('Infinity') OR weight = double('-Infinity') OR u IS NULL OR v IS NULL OR u >= v").limit(1).count():
            raise ValueError("the stored graph is damaged")
        return edges, self.table("mentions", version)

    def record(self, table: str, run: str, batch: int, rows: list[tuple]) -> None:
        """Keeps the rows of a batch of a run in a table of RECORDS, in place of those it had: a batch that is run again adds none."""
        schema = T.StructType([f for f in RECORDS[table].fields if f.name not in ("run", "batch")])
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{table}/run={quote(run, safe='')}/batch={batch}")

    def records(self, table: str) -> DataFrame:
        """The table of all runs; names of runs come back as they were given where those are plain."""
        if not self._fs.exists(self._path(f"{self.path}/{table}")):
            return self.spark.createDataFrame([], RECORDS[table])
        found = self.spark.read.schema(RECORDS[table]).parquet(f"{self.path}/{table}")
        return found.select(*RECORDS[table].names)

    def delete(self, source_id: str | None = None, source_path: str | None = None, config: EngineConfig | None = None) -> int:
        """Removes a source by id or by path, never by name; the number of its chunks. Without a match nothing is published."""
        gone = self.spark.createDataFrame([(source_id, source_path)], "source_id string, source_path string")
        n = self.table("chunks").filter((F.col("source_id") == source_id) | (F.col("source_path") == source_path) if source_id and source_path else F.col("source_id") == source_id if source_id else F.col("source_path") == source_path).count()
        if n:
            self.commit(config or EngineConfig(), {k: self.spark.createDataFrame([], TABLES[k]) for k in ("sources", "chunks", "vectors")}, gone)
        return n

    def rebuild_needed(self, config: EngineConfig, files: DataFrame, force: bool = False) -> bool:
        """Whether the index is forced, missing, of another configuration, or any file is new or changed."""
        return force or not self.exists() or not self.matches(config) or stale_sources(files, self.table("sources")).limit(1).count() > 0
