"""Benchmark decontamination with an FM-index for each shard of the training texts.

1. ``build_index`` cuts the words of all texts into shards of bounded size and writes one row for each: its vocabulary, the
   Burrows-Wheeler transform of its words as a wavelet matrix (a bit vector for each bit of a word's number, with counts of
   the ones before each place), and the positions of every ``SAMPLE``-th suffix. The index doesn't depend on the benchmark.
2. ``search`` takes the distinct windows of the benchmark in blocks of bounded size, sends each block to all shards, and
   narrows the interval of every window at once, from its last word to its first. Suffixes that are left are followed
   backwards to a sampled one, which gives the place of the occurrence.
3. Places become runs of words; runs of one document are merged, whether from one shard or from several.

Words are compared by their bytes, never by hashes. A document longer than a shard goes on in the next one, which begins
with the words that a window across the border needs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, unused
from .textkit import LOWER, Runs, ragged, slices

WINDOW = 10
SHARD_WORDS, SAMPLE = 1 << 19, 16
#: Pairs of a window and an item that go to all tasks at once, and bytes of their words.
BLOCK_PAIRS, BLOCK_BYTES = 1 << 17, 32 << 20

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes outside words: ASCII that is neither letter nor digit.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[c for c in range(128) if not re.match("[0-9A-Za-z]", chr(c))]] = True


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, of numbers where 0 ends a string (the last one is 0); equal strings go by place, as ends do.

    Several symbols at once come first, and then only what is still alike is sorted, by twice as many symbols each time.
    """
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + (len(ends) - 1)
    rank[ends] = np.arange(len(ends))
    bits = max(1, int(rank.max()).bit_length())
    depth = max(1, 63 // bits)
    key = rank.copy()
    for k in range(1, depth):
        key <<= bits
        key[:-k] |= rank[k:]
    order = np.argsort(key)
    live, key = np.arange(len(text)), key[order]
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        rank[order[live]] = np.repeat(live[first], size)
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            return order
        at = order[live]
        key = rank[at] << 32 | rank[at + depth]
        sort = np.argsort(key)
        order[live], key = at[sort], key[sort]
        depth *= 2


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, packed: np.ndarray):
        self.words = packed
        self.before = np.zeros(len(packed) + 1, np.int64)
        np.cumsum(np.bitwise_count(packed), out=self.before[1:])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """Words of 64 bits, with one more than fits, so that the place after the last bit can be asked for."""
        out = np.zeros(len(bits) // 64 + 1, "<u8")
        packed = np.packbits(bits, bitorder="little")
        out.view(np.uint8)[: len(packed)] = packed
        return out

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """Ranks of symbols in a sequence: one bit vector for each bit of the symbols, the highest first, zeros before ones."""

    def __init__(self, levels: list[np.ndarray], zeros: list[int]):
        self.levels, self.zeros = [Bits(x) for x in levels], zeros

    @staticmethod
    def pack(symbols: np.ndarray, width: int) -> tuple[list[np.ndarray], list[int]]:
        levels, zeros, symbols = [], [], symbols.astype(np.uint16 if width <= 16 else np.uint32)
        for bit in reversed(range(width)):
            one = symbols & symbols.dtype.type(1 << bit) != 0
            levels.append(Bits.pack(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])
            zeros.append(int(len(one) - one.sum()))
        return levels, zeros

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often each symbol is before each of the places."""
        moved = [np.zeros(len(symbol), np.int64), *places]
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (len(self.levels) - 1 - k)) & 1 != 0
            for i, p in enumerate(moved):
                ones = level.ones(p)
                moved[i] = np.where(one, zeros + ones, p - ones)
        return [p - moved[0] for p in moved[1:]]

    def symbol(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.at(place), level.ones(place)
            out = out << 1 | one
            place = np.where(one, zeros + ones, place - ones)
        return out


class FmIndex:
    """One shard: strings of symbols from 1, each with a 0 at its end, in one text."""

    def __init__(self, size: int, width: int, bits: bytes, zeros: bytes, marks: bytes, samples: bytes, less: bytes):
        words = np.frombuffer(bits, "<u8").reshape(width, -1)
        self.size, self.wavelet = size, Wavelet(list(words), np.frombuffer(zeros, "<i4").tolist())
        self.marks, self.samples = Bits(np.frombuffer(marks, "<u8")), np.frombuffer(samples, "<i4")
        self.less = np.frombuffer(zlib.decompress(less), "<i4").astype(np.int64)

    @staticmethod
    def build(text: np.ndarray, symbols: int) -> dict:
        """The parts of the index of a text of symbols below ``symbols``."""
        order = suffix_order(text)
        before = text[order - 1]  # before the first is the last, an end
        width = max(1, (symbols - 1).bit_length())
        levels, zeros = Wavelet.pack(before, width)
        marked = (order % SAMPLE == 0) | (before == 0)
        less = np.zeros(symbols + 1, "<i4")
        np.cumsum(np.bincount(text, minlength=symbols), out=less[1:])
        return {
            "size": len(text), "width": width, "bits": b"".join(x.tobytes() for x in levels), "zeros": np.array(zeros, "<i4").tobytes(),
            "marks": Bits.pack(marked).tobytes(), "samples": order[marked].astype("<i4").tobytes(), "less": zlib.compress(less.tobytes(), 1),
        }

    def intervals(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and end row of the suffixes that begin with each phrase: rows of symbols, -1 before shorter ones, 0 for
        words that the shard doesn't have."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        live = np.flatnonzero((phrases != 0).all(axis=1))
        high[live] = self.size
        for k in reversed(range(phrases.shape[1])):
            live = live[(phrases[live, k] > 0) & (low[live] < high[live])]
            symbol = phrases[live, k]
            a, b = self.wavelet.rank(symbol, low[live], high[live])
            low[live], high[live] = self.less[symbol] + a, self.less[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, by steps back to a sampled one (the first symbol of each string is)."""
        out, live, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            marked = self.marks.at(rows)
            out[live[marked]] = self.samples[self.marks.ones(rows[marked])] + steps
            live, rows, steps = live[~marked], rows[~marked], steps + 1
            symbol = self.wavelet.symbol(rows)
            rows = self.less[symbol] + self.wavelet.rank(symbol, rows)[0]
        return out


_BYTES = ("bits", "zeros", "marks", "samples", "less", "vocabulary")
#: Of the documents, or parts of them, in a shard: where each begins in its document and in the shard's text, and the words
#: that windows may begin at.
_PLACES = ("row", "first", "words", "start")
SHARDS = f"size int, width int, {', '.join(f'{c} binary' for c in _BYTES)}, {', '.join(f'{c} array<long>' for c in _PLACES)}, id array<{{}}>"


def _shard_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("size", pa.int32()), ("width", pa.int32()), *((c, pa.binary()) for c in _BYTES), *((c, pa.list_(pa.int64())) for c in _PLACES), ("id", pa.list_(id_type))])


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows one after the other, in small letters, and how many each row has."""
    runs = Runs(buf, offs, SEPARATORS)
    ends = np.zeros(len(runs) + 1, np.int32)
    np.cumsum(runs.end - runs.start, out=ends[1:])
    data = LOWER[buf[~SEPARATORS[buf]]]
    return pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.bincount(runs.row, minlength=len(offs) - 1)


def _cuts(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first word, end word) of shards: whole rows while they fit, longer rows in parts."""
    ends, at, total = np.cumsum(counts), 0, int(counts.sum())
    while at < total:
        k = int(np.searchsorted(ends, at + most, "right"))
        end = int(ends[k - 1]) if k and ends[k - 1] > at else at + most
        yield at, min(end, total)
        at = min(end, total)


def _shards(words: pa.Array, counts: np.ndarray, rows: np.ndarray, ids: pa.Array, window: int, most: int) -> Iterator[pa.RecordBatch]:
    begins, schema = np.cumsum(counts) - counts, _shard_schema(ids.type)
    empty = np.flatnonzero(counts == 0)
    for lo, hi in _cuts(counts, most):
        held = np.flatnonzero((begins < hi) & (begins + counts > lo))
        start = np.maximum(begins[held], lo)
        own = np.minimum(begins[held] + counts[held], hi) - start
        size = np.minimum(own + window - 1, begins[held] + counts[held] - start)  # what a window needs after the border
        coded = words.slice(int(start[0]), int(start[-1] + size[-1] - start[0])).dictionary_encode()
        place = np.cumsum(size + 1) - size - 1
        text = np.zeros(int(size.sum()) + len(held), np.int64)
        text[ragged(place, size)] = coded.indices.to_numpy()[ragged(start - start[0], size)] + 1
        parts = FmIndex.build(text, len(coded.dictionary) + 1)
        parts |= {"vocabulary": zlib.compress(b"\n".join(coded.dictionary.to_pylist()), 1), "row": rows[held], "first": start - begins[held], "words": own, "start": place, "id": ids.take(pa.array(held)).to_pylist()}
        yield pa.RecordBatch.from_pylist([parts], schema)
    if len(empty):
        none = np.zeros(len(empty), np.int64)
        yield pa.RecordBatch.from_pylist([{"size": 0, "row": rows[empty], "first": none, "words": none, "start": none, "id": ids.take(pa.array(empty)).to_pylist()}], schema)


def build_index(docs: DataFrame, row: str, key: str = "doc_id", window: int = WINDOW, text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards of all texts as a stored table; ``row`` is a column of distinct longs that names the rows, ``key`` goes along.

    It can find phrases of up to ``window`` words. Null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            for lo, hi, buf, offs in slices(b.column(2)):
                w, c = words_of(buf, offs)
                if parts and sum(len(p[0]) for p in parts) + len(w) > shard_words:
                    yield from closed(parts)
                    parts = []
                parts.append((w, c, b.column(0).to_numpy()[lo:hi], b.column(1).slice(lo, hi - lo)))
        if parts:
            yield from closed(parts)

    def closed(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        w, c, r, k = zip(*parts, strict=True)
        return _shards(pa.concat_arrays(w), np.concatenate(c), np.concatenate(r), pa.concat_arrays(k), window, shard_words)

    kind = docs.schema[key].dataType.simpleString()
    return materialise(docs.select(row, key, text).mapInArrow(run, SHARDS.format(kind)), "shards")


def phrases(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, item): the distinct windows of each item, words joined by spaces; an item of fewer words is one window.

    Items without words (null texts too) have none. Items are named by their decimal or other text; repeated rows count once.
    """
    capital, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = benchmark.select(F.col(item).cast("string").alias("item"), F.regexp_extract_all(F.translate(text, capital, small), F.lit(WORDS), F.lit(0)).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, window), " "))
    return words.filter("size(w) > 0 AND item IS NOT NULL").select(F.explode(F.array_distinct(cut)).alias("phrase"), "item").distinct()


class Block:
    """Some of the phrases, as numbers of their own vocabulary, and the items of each."""

    def __init__(self, table: pa.Table, window: int):
        coded = table.column("phrase").combine_chunks().dictionary_encode()
        phrase = coded.indices.to_numpy()
        split = [p.split(" ") for p in coded.dictionary.to_pylist()]
        number: dict[str, int] = {}
        self.words = np.full((len(split), window), -1, np.int64)
        for k, ws in enumerate(split):
            self.words[k, window - len(ws) :] = [number.setdefault(w, len(number)) for w in ws]
        self.vocabulary = [w.encode() for w in number]
        self.length = np.array([len(ws) for ws in split], np.int64)
        items = table.column("item").combine_chunks().dictionary_encode()
        self.items = items.dictionary.to_pylist()
        order = np.argsort(phrase, kind="stable")
        self.item = items.indices.to_numpy()[order]
        self.from_ = np.searchsorted(phrase[order], np.arange(len(split) + 1))

    def found(self, shard: dict) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place in the shard's text) of every occurrence."""
        known = pa.array(zlib.decompress(shard["vocabulary"]).split(b"\n"), pa.binary())
        symbol = pc.index_in(pa.array(self.vocabulary, pa.binary()), value_set=known).fill_null(-1).to_numpy() + 1
        there = np.where(self.words < 0, -1, symbol[self.words])
        asked = np.flatnonzero((there != 0).all(axis=1))
        if not len(asked):
            return asked, asked
        index = FmIndex(*(shard[k] for k in ("size", "width", "bits", "zeros", "marks", "samples", "less")))
        low, high = index.intervals(there[asked])
        return np.repeat(asked, high - low), index.locate(ragged(low, high - low))


_HITS = "row long, words long, spans array<struct<start: long, end: long>>, items array<string>"
_HIT_SCHEMA = pa.schema([("row", pa.int64()), ("words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def union_of(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans within each group; groups are small numbers."""
    if not len(group):
        return group, start, end
    order = np.lexsort((start, group))
    g, s, e = group[order], start[order], end[order]
    step = int(max(e.max(), 1)) + 1
    reach = np.maximum.accumulate(e + g * step)
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] + g[1:] * step > reach[:-1])])
    first = np.flatnonzero(new)
    return g[first], s[first], reach[np.append(first[1:], len(g)) - 1] - g[first] * step


def _lists(group: np.ndarray, groups: np.ndarray) -> pa.Array:
    return pa.array(np.append(np.searchsorted(group, groups), len(group)), pa.int32())


def _hits(block: Block, shard: dict) -> pa.RecordBatch | None:
    phrase, place = block.found(shard)
    if not len(phrase):
        return None
    starts, first = np.array(shard["start"]), np.array(shard["first"])
    doc = np.searchsorted(starts, place, "right") - 1
    at = place - starts[doc] + first[doc]
    g, s, e = union_of(doc, at, at + block.length[phrase])
    pair = np.unique(doc * len(block.length) + phrase)  # each phrase once for a document
    doc, phrase = pair // len(block.length), pair % len(block.length)
    many = block.from_[phrase + 1] - block.from_[phrase]
    pair = np.unique(np.repeat(doc, many) * len(block.items) + block.item[ragged(block.from_[phrase], many)])
    doc, item = pair // len(block.items), pair % len(block.items)
    docs = np.unique(g)
    spans = pa.StructArray.from_arrays([pa.array(s), pa.array(e)], names=["start", "end"])
    items = pa.array(block.items, pa.string()).take(pa.array(item))
    columns = [pa.array(np.array(shard["row"])[docs]), pa.array(np.zeros(len(docs), np.int64)), pa.ListArray.from_arrays(_lists(g, docs), spans), pa.ListArray.from_arrays(_lists(doc, docs), items)]
    return pa.RecordBatch.from_arrays(columns, schema=_HIT_SCHEMA)


def search(index: DataFrame, asked: DataFrame, window: int = WINDOW, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(row, words, spans, items, id) of every row of the index: spans of words in phrases, maximal and in order, and the items of
    those phrases, each once and in order.

    ``asked`` is what ``phrases`` gives. It is sent to the tasks in blocks of about ``block_pairs`` pairs of a phrase and an
    item, as many blocks as that takes; a phrase of many items may be in several.
    """
    asked = materialise(asked, "phrases")
    pairs, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    blocks = max(ceil(pairs / block_pairs), ceil(size / BLOCK_BYTES))
    words = index.select(F.explode(F.arrays_zip("row", "words", "id")).alias("d"))
    found = words.select("d.row", "d.words", F.lit(None).cast("array<struct<start: bigint, end: bigint>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"), "d.id")
    for k in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == k).toArrow()
        sent = index.sparkSession.sparkContext.broadcast(Block(part, window)) if len(part) else None
        if sent is not None:
            found = found.unionByName(index.filter("size > 0").mapInArrow(_searcher(sent), _HITS).withColumn("id", F.lit(None).cast(found.schema["id"].dataType)))
    together = found.groupBy("row").agg(F.sum("words").alias("words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("id").alias("id"))
    return together.mapInArrow(_merged, together.schema)


def _searcher(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                hits = _hits(sent.value, b.slice(k, 1).to_pylist()[0])
                if hits is not None:
                    yield hits

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = b.column("spans")
        group = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        flat = spans.flatten()
        g, s, e = union_of(group, flat.field("start").to_numpy(), flat.field("end").to_numpy())
        merged = pa.ListArray.from_arrays(_lists(g, np.arange(len(spans))), pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["start", "end"]))
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("words"), merged, b.column("items"), b.column("id")], names=["row", "words", "spans", "items", "id"])


def hit_words() -> Column:
    """Words in the spans of ``search``, which do not overlap."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    Null and empty texts have no words; repeated rows are given as often. No documents, no rows; an empty benchmark hits nothing.
    """
    index = build_index(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "row", "doc_id", window, shard_words=shard_words)
    return search(index, phrases(benchmark, window), window, block_pairs).select(F.col("id").alias("doc_id"), F.col("words").alias("n_words"), hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the passages that the benchmark has: from the first letter of each span of hit words to the last.

    All rows and columns stay, null texts too, and so does what is around the passages.
    """
    row, spans = unused(docs.columns, "row"), unused(docs.columns, "spans")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = search(build_index(numbered, row, row, window, shard_words=shard_words), phrases(benchmark, window), window)
    hit = found.filter("size(spans) > 0").select(F.col("row").alias(row), F.col("spans").alias(spans))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place).to_pylist()
            for k, cut in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if cut:
                    raw = texts[k].encode()
                    buf = np.frombuffer(raw, np.uint8)
                    runs = Runs(buf, np.array([0, len(buf)]), SEPARATORS)
                    ends = [0, *(int(runs.end[c["end"] - 1]) for c in cut)]
                    begins = [*(int(runs.start[c["start"]]) for c in cut), len(raw)]
                    texts[k] = b"".join(raw[a:z] for a, z in zip(ends, begins, strict=True)).decode()
            kept = [pa.array(texts, pa.string()) if j == place else b.column(j) for j in range(len(docs_names))]
            yield pa.RecordBatch.from_arrays(kept, names=docs_names)

    docs_names = docs.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return numbered.join(hit, row, "left").select(*docs.columns, spans).mapInArrow(run, schema)
