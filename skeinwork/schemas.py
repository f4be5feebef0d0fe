"""Types of every stored table."""

from __future__ import annotations

from pyspark.sql import types as T


_STRINGS = T.ArrayType(T.StringType())
_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _struct(*fields: tuple[str, str | T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, _SIMPLE[t] if isinstance(t, str) else t) for n, t in fields])


_SOURCE = (("source_id", "string"), ("source_path", "string"), ("source_name", "string"), ("source", "string"), ("file_type", "string"), ("content_sha256", "string"), ("source_size", "bigint"), ("source_mtime_ns", "bigint"))

SOURCES = _struct(*_SOURCE)
PAGES = _struct(*_SOURCE, ("page", "int"), ("text", "string"))
CHUNKS = _struct(*_SOURCE, ("chunk_id", "string"), ("chunk_index", "int"), ("page", "int"), ("chunk_type", "string"), ("text", "string"), ("page_text", "string"))
VECTORS = _struct(("chunk_id", "string"), ("embedding", T.ArrayType(T.FloatType())))
TOKENS = _struct(("chunk_id", "string"), ("document_hash", "string"), ("tokens", _STRINGS))
EDGES = _struct(("u", "string"), ("v", "string"), ("weight", "double"))
ENTITY_LISTS = _struct(("chunk_id", "string"), ("document_hash", "string"), ("entities", _STRINGS))
MENTIONS = _struct(("entity", "string"), ("chunk_id", "string"))
MANIFEST_SOURCES = _struct(*_SOURCE, ("chunk_ids", _STRINGS))
RANKED = _struct(("query_id", "string"), ("chunk_id", "string"), ("score", "double"), ("rank", "int"))
CITATION = _struct(("citation_id", "string"), ("chunk_id", "string"), ("source_id", "string"), ("source_name", "string"), ("source_path", "string"), ("page", "int"), ("chunk_index", "int"), ("snippet", "string"))
METRIC = _struct(("seq", "bigint"), ("retrieval_ms", "double"), ("candidate_count", "int"), ("selected_count", "int"), ("source_count", "int"), ("manifest_version", "bigint"), ("refused", "boolean"), ("error_category", "string"))
BENCHMARK = _struct(("schema_version", "int"), ("description", "string"), ("k", "int"), ("corpus", T.ArrayType(_struct(("chunk_id", "string"), ("text", "string")))), ("cases", T.ArrayType(_struct(("id", "string"), ("query", "string"), ("relevant_chunk_ids", _STRINGS)))), ("quality_gates", T.MapType(T.StringType(), T.DoubleType())))
ERRORS = _struct(("run", "string"), ("batch", "bigint"), ("source", "string"), ("reason", "string"))
PROGRESS = _struct(("run", "string"), ("batch", "bigint"), ("version", "bigint"), ("upserts", "bigint"), ("deletes", "bigint"), ("chunks", "bigint"), ("ms", "double"))
FILE_EVENTS = _struct(("seq", "bigint"), ("ts", "timestamp"), ("kind", "string"), ("path", "string"), ("dest", "string"))
