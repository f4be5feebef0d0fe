"""From ranked chunks to citations, a context of bounded size, and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_else, snippet

#: The frame of a quoted chunk.
MARKER = "\n[document context truncated]"
CLOSING, CLOSED = "</untrusted_document>", "</untrusted_document_text>"
JOINT = "\n\n"


def ambiguous_names(chunks: DataFrame) -> DataFrame:
    """(name, identities) of display names that stand for several sources."""
    name = or_else("source_name", "source", F.lit("unknown"))
    identity = or_else("source_id", "source_path", F.lit("legacy"))
    return chunks.groupBy(name.alias("name")).agg(F.count_distinct(identity).alias("identities")).filter("identities > 1")


def labelled(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds ``label``: the display name, or the path where the name is ambiguous in the whole corpus."""
    name = or_else("source_name", "source", F.lit("unknown"))
    marked = ambiguous_names(chunks).select(F.col("name").alias("__name"), F.lit(True).alias("__twice"))
    out = ranked.withColumn("__name", name).join(marked, "__name", "left")
    return out.withColumn("label", F.when(F.col("__twice"), or_else("source_path", "__name")).otherwise(F.col("__name"))).drop("__name", "__twice")


def citations(ranked: DataFrame) -> DataFrame:
    """One record for each ranked chunk: citation_id S1, S2 ... by rank and a snippet; other columns stay, without the text."""
    return ranked.withColumns({"citation_id": F.concat(F.lit("S"), F.col("rank").cast("string")), "snippet": snippet("text")}).drop("text")


def citation_payload(records: DataFrame) -> DataFrame:
    return records.select("query_id", "citation_id", F.to_json(F.struct(*[c for c in records.columns if c != "query_id"])).alias("payload"))


def source_line(label: str = "label") -> Column:
    """"[S1] name (p.4, chunk 3; chunk_id=...): snippet..." for a chunk with page, chunk_index, chunk_id and text."""
    where = F.concat_ws(", ", F.when(F.col("page").isNotNull(), F.format_string("p.%d", "page")), F.when(F.col("chunk_index").isNotNull(), F.format_string("chunk %d", "chunk_index")))
    return F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), F.col(label), F.lit(" ("), where, F.lit("; chunk_id="), F.col("chunk_id"), F.lit("): "), snippet("text"), F.lit("..."))


def format_sources(ranked: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, sources): the lines of the first ``most`` chunks."""
    lines = ranked.filter(F.col("rank") <= most).select("query_id", "rank", source_line().alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("sources"))


def build_context(ranked: DataFrame, max_chars: int = 60_000, most: int = 5) -> DataFrame:
    """(query_id, context): the first ``most`` chunks in frames, within max_chars characters in all.

    A chunk that no longer fits is cut, with a marker if there is room for one; a frame that doesn't fit is left out and the
    next is tried; nothing follows once no character is left. Ranks keep their numbers.
    """
    head = F.concat(F.lit("[Source: "), F.col("label"), F.lit("] [Citation: S"), F.col("rank").cast("string"), F.lit(']\n<untrusted_document chunk_id="'), F.col("chunk_id"), F.lit('">\n'))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit(CLOSING), F.lit(CLOSED))
    tail = "\n" + CLOSING
    rows = ranked.filter(F.col("rank") <= most).select("query_id", F.struct("rank", head.alias("head"), body.alias("body")).alias("row"))

    def add(state: Column, row: Column) -> Column:
        left = F.lit(max_chars) - F.length(state["text"]) - F.when(state["any"], F.lit(len(JOINT))).otherwise(F.lit(0))
        room = left - F.length(row["head"]) - len(tail)
        cut = F.when(room >= len(MARKER), F.concat(F.rtrim(F.substring(row["body"], F.lit(1), room - len(MARKER)), F.lit(" \t\n\r\x0b\x0c")), F.lit(MARKER))).otherwise(F.substring(row["body"], F.lit(1), room))
        fitted = F.when(F.length(row["body"]) > room, cut).otherwise(row["body"])
        block = F.concat(F.when(state["any"], F.lit(JOINT)).otherwise(F.lit("")), row["head"], fitted, F.lit(tail))
        full = state["full"] | (left <= 0)
        takes = ~full & (room >= 0)
        return F.struct(F.when(takes, F.concat(state["text"], block)).otherwise(state["text"]).alias("text"), (state["any"] | takes).alias("any"), full.alias("full"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("any"), F.lit(False).alias("full"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("row")).alias("rows")).select("query_id", F.aggregate("rows", start, add, lambda s: s["text"]).alias("context"))


def enrich(ranked: DataFrame) -> DataFrame:
    """Anchor chunks get the stored text of their first page in place of their own."""
    return ranked.withColumn("text", F.when((F.col("chunk_type") == "anchor") & F.col("page_text").isNotNull(), F.col("page_text")).otherwise(F.col("text")))


def last_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """The last n rows of each conversation, with their place from the end; rows of one turn go by role and text."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return turns.withColumn("back", back).filter(F.col("back") <= n)


def messages(history: DataFrame, prompts: DataFrame, system: str, n: int = 5) -> DataFrame:
    """(conv_id, messages array<struct<role, content>>): system text, the last n rows of history in order, and the prompt."""
    recent = last_turns(history, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("rows"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    past = F.coalesce(F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), F.array().cast("array<struct<role:string,content:string>>"))
    return prompts.join(recent, "conv_id", "left").select("conv_id", F.concat(F.array(message("system", F.lit(system))), past, F.array(message("user", F.col("prompt")))).alias("messages"))
