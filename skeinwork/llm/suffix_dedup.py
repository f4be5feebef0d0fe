"""Removal of repeated byte strings by merged Burrows-Wheeler transforms of shards.

A byte goes when a string of ``LENGTH`` bytes covers it that also starts earlier: in a smaller doc_id, or earlier in the
same document. The work is dealt out by content, so that equal strings always meet:

1. Each window of LENGTH bytes is keyed by the least hash among its ``GRAM``-byte parts (a minimizer); adjoining windows with
   one key form a segment. Only keys and fingerprints of segments are shuffled, packed by bucket. A segment that is equal as
   a whole to an earlier one goes; of keys that occur in several different segments, the first of each goes on.
2. The bytes of those segments are gathered by key. Shards of them get their own transform, and the shards' transforms are
   merged by iterative interleave refinement: starting from one shard after the other, each pass through the symbols sorts
   the interleaving by one more symbol, without sorting any suffix again. The passes before two neighbours part are their
   common prefix, so after LENGTH passes the runs that haven't parted are the repeated intervals. In each, the first
   position stays, and the windows at all others go.
3. Runs that go are gathered by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, unused
from .textkit import Hasher, ragged, slices

LENGTH, GRAM = 100, 32
BUCKETS = 1024
SHARD_BYTES, MERGE_BYTES = 128 << 10, 1 << 20
SEGMENT, SPAN = 0, 1
_PLACE = np.uint64(0xFF)
#: Added to a segment's number of windows (less than that) where it may repeat a string within itself.
INNER = 128


def minimizer_segments(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, fingerprint, row, start in the row, number of windows, plus INNER or not) of the segments of each text."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return none
    wide = buf.astype(np.uint64)
    two = wide[:-1] | (wide[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    h = eight[: len(buf) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += eight[k : k + len(h)]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h &= ~_PLACE
    place = np.arange(len(h), dtype=np.uint64) & _PLACE
    least, tie = _sliding_least(h | place, n), _sliding_least(h | (_PLACE - place), n)
    tie = (least & _PLACE) + (tie & _PLACE) != _PLACE  # the least part occurs twice in the window
    row_of_start = np.repeat(np.arange(len(offs) - 1), np.maximum(0, np.diff(offs) - LENGTH + 1))
    if not len(row_of_start):
        return none
    size = np.maximum(0, np.diff(offs) - LENGTH + 1)
    starts = ragged(offs[:-1], size)
    m = least[starts]
    first = np.flatnonzero((np.diff(m, prepend=~m[:1]) != 0) | (np.diff(row_of_start, prepend=-1) != 0))
    count = np.diff(np.append(first, len(m)))
    begin, row = starts[first], row_of_start[first]
    inner = np.maximum.reduceat(tie[starts], first).astype(np.int64) * INNER
    return m[first] >> np.uint64(8), Hasher(buf).spans(begin, begin + count + LENGTH - 1), row, begin - offs[row], count | inner


def _sliding_least(v: np.ndarray, n: int) -> np.ndarray:
    """The least of the LENGTH - GRAM + 1 values from each of the first n places on."""
    width, want = 1, LENGTH - GRAM + 1
    while width * 2 <= want:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[:n], v[want - width : want - width + n])


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal runs of the union of half-open spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], np.append(end[:-1][new[1:]], end[-1])


_PAIR = np.dtype([("start", "<u4"), ("end", "<u4")])
_SEGMENT = np.dtype([("key", "<u8"), ("start", "<u4"), ("count", "<u4")])


def _span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(doc_id, packed spans)."""
    order = np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else ():
        s, e = merge_spans(start[part], end[part])
        packed = np.empty(len(s), _PAIR)
        packed["start"], packed["end"] = s, e
        yield int(doc[part[0]]), packed.tobytes()


def _firsts(key: np.ndarray, mark: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first place of each key and fingerprint, and of later places (the same place again is neither)."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((start, doc, mark, key))
    k, m, d, s = key[order], mark[order], doc[order], start[order]
    alike = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    new = np.concatenate([[True], ~alike])
    again = np.concatenate([[False], alike & (d[1:] == d[:-1]) & (s[1:] == s[:-1])])
    return order[new], order[~new & ~again]


_ROWS = "kind int, bucket long, doc_id long, data binary"


def _row_batch(kind: int, rows: list[tuple[int, int | None, bytes]]) -> pa.RecordBatch:
    """rows: (bucket, doc_id, data)."""
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "doc_id", "data"])


_PACKED = (("key", "<u8"), ("print", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("count", "<u1"))


def _pack(columns: list[np.ndarray]) -> bytes:
    """One after the other, so that what repeats or rises slowly compresses."""
    return b"".join(c.astype(kind).tobytes() for c, (_, kind) in zip(columns, _PACKED, strict=True))


def _unpack(data: list[bytes]) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for _, k in _PACKED)
    parts: list[list[np.ndarray]] = [[] for _ in _PACKED]
    for d in data:
        n, at = len(d) // width, 0
        for p, (_, kind) in zip(parts, _PACKED, strict=True):
            p.append(np.frombuffer(d, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def _keyed(docs: DataFrame) -> DataFrame:
    """Segments of all texts, packed by bucket of their key; of those equal within a batch only the first, and the others' spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, parts = b.column("doc_id").to_numpy(), []
            for lo, _, buf, offs in slices(b.column("text")):
                key, mark, row, start, count = minimizer_segments(buf, offs)
                parts.append((key, mark, ids[lo + row], start, count))
            if not parts:
                continue
            key, mark, doc, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            first, later = _firsts(key, mark, doc, start)
            if len(later):
                yield _row_batch(SPAN, [(d % BUCKETS, d, x) for d, x in _span_rows(doc[later], start[later], start[later] + count[later] % INNER + LENGTH - 1)])
            bucket = (key[first] % np.uint64(BUCKETS)).astype(np.int64)
            first = first[np.lexsort((start[first], doc[first], bucket))]
            bucket = (key[first] % np.uint64(BUCKETS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = [(int(bucket[p[0]]), None, _pack([x[first[p]] for x in (key, mark, doc, start, count)])) for p in np.split(np.arange(len(first)), cuts)] if len(first) else []
            for lo in range(0, len(rows), 256):
                yield _row_batch(SEGMENT, rows[lo : lo + 256])

    return docs.mapInArrow(run, _ROWS)


def _sifted(keyed: DataFrame) -> DataFrame:
    """Spans of segments that are equal to an earlier one, and the first ones (by document) of keys with several of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[bytes] = []
        for b in batches:
            kinds = b.column("kind").to_numpy()
            spans = np.flatnonzero(kinds == SPAN)
            if len(spans):
                yield b.take(pa.array(spans))
            data += b.column("data").take(pa.array(np.flatnonzero(kinds == SEGMENT))).to_pylist()
        if not data:
            return
        key, mark, doc, start, count = _unpack(data)
        del data
        order = np.argsort(key, kind="stable")
        laid = key[order]
        same = laid[1:] == laid[:-1]
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (count[order] >= INNER)]
        key, mark, doc, start, count = key[twice], mark[twice], doc[twice], start[twice].astype(np.int64), count[twice].astype(np.int64)
        if not len(key):
            return
        first, later = _firsts(key, mark, doc, start)
        rows = [(0, d, x) for d, x in _span_rows(doc[later], start[later], start[later] + count[later] % INNER + LENGTH - 1)]
        for lo in range(0, len(rows), 4096):
            yield _row_batch(SPAN, rows[lo : lo + 4096])
        order = first[np.argsort(key[first], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        several = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (count[order] >= INNER)]
        several = several[np.argsort(doc[several], kind="stable")]
        rows = []
        for part in np.split(several, np.flatnonzero(np.diff(doc[several])) + 1) if len(several) else ():
            packed = np.empty(len(part), _SEGMENT)
            packed["key"], packed["start"], packed["count"] = key[part], start[part], count[part] % INNER
            rows.append((0, int(doc[part[0]]), packed.tobytes()))
        for lo in range(0, len(rows), 4096):
            yield _row_batch(SEGMENT, rows[lo : lo + 4096])

    return keyed.repartition("bucket").mapInArrow(run, _ROWS)


class Shard:
    """Strings with their Burrows-Wheeler transform: rows are suffixes in order, the empty one at each string's end included.

    ``symbols`` has the byte before each suffix, and ``back`` the row of the suffix that begins with it. Suffixes are ordered
    by LENGTH symbols or more; beyond that order doesn't matter, as the merge goes no further.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, length: int = LENGTH):
        """data: the strings, one after the other."""
        size = lengths + 1
        begin = np.cumsum(size) - size
        n = int(size.sum())
        text = np.zeros(n, np.uint8)
        text[ragged(begin, lengths)] = data
        string = np.repeat(np.arange(len(lengths)), size)
        place = np.arange(n) - begin[string]
        rest = lengths[string] - place
        word = np.zeros(n, np.uint64)
        for i in range(min(8, n)):
            word[: n - i] |= text[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
        word &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.minimum(rest, 8).astype(np.uint64)) % np.uint64(64))
        word[rest == 0] = 0
        rank, reach = self._ranks(word), 8
        while reach < length and int(rank.max(initial=0)) < n - 1:
            after = np.zeros(n, np.int64)
            after[: max(0, n - reach)] = rank[reach:] + 1
            after[rest < reach] = 0
            rank = self._ranks(rank * (n + 1) + after)
            reach *= 2
        order = np.argsort(rank)
        row = np.empty(n, np.int32)
        row[order] = np.arange(n, dtype=np.int32)
        before = np.maximum(order - 1, 0)
        self.symbols, self.back = text[before], row[before]
        self.string, self.place, self.rest = string[order], place[order], rest[order]
        self.n_strings = len(lengths)

    @staticmethod
    def _ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        laid = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], laid[1:] != laid[:-1]]))
        return rank


def repeated_intervals(shards: list[Shard], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' transforms; (row, interval) of the suffixes that share ``length`` symbols with another one.

    Rows count over all shards in turn. The interleaving begins with the shards one after the other. A pass reads the symbol
    before each suffix in the order so far and moves the suffixes that begin with it, in that order, to the symbol's place:
    then the interleaving is sorted by one symbol more. Neighbours that differ there part, and their common prefix is the
    number of passes before. A suffix that has parted from both neighbours is settled, and so is whatever would be reached
    from it, so it is left out; so are suffixes that are too near an end of their string to begin ``length`` symbols.
    """
    bases = np.cumsum([0] + [len(s.symbols) for s in shards[:-1]])
    symbols = np.concatenate([s.symbols for s in shards])
    back = np.concatenate([s.back + np.int32(b) for s, b in zip(shards, bases, strict=True)])
    row = np.flatnonzero(np.concatenate([s.place >= length for s in shards])).astype(np.int32)
    block = np.zeros(len(row), np.int32)
    for _ in range(length):
        before = symbols[row]
        by = np.argsort(before, kind="stable")
        before, row, block = before[by], back[row[by]], block[by]
        parted = np.ones(len(row) + 1, bool)
        np.not_equal(before[1:], before[:-1], out=parted[1:-1])
        parted[1:-1] |= block[1:] != block[:-1]
        together = ~(parted[:-1] & parted[1:])
        block = np.cumsum(parted[:-1], dtype=np.int32)[together]
        row = row[together]
    return row, block


def later_windows(strings: list[tuple[np.ndarray, np.ndarray]], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each window of ``length`` bytes that also starts at an earlier place.

    strings: shards as (bytes, lengths); doc and start: the place of each string, over all shards in turn.
    """
    shards = [Shard(data, lengths, length) for data, lengths in strings]
    row, interval = repeated_intervals(shards, length)
    base = np.cumsum([0] + [s.n_strings for s in shards[:-1]])
    string = np.concatenate([s.string + b for s, b in zip(shards, base, strict=True)])[row]
    place = np.concatenate([s.place for s in shards])[row]
    d, p = doc[string], start[string] + place
    order = np.lexsort((p, d, interval))
    i, d, p = interval[order], d[order], p[order]
    first = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    head_d, head_p = d[first][group], p[first][group]
    later = order[(d != head_d) | (p != head_p)]  # the same place, seen in two strings, is no repetition
    return string[later], place[later]


def _bytes_of_segments(docs: DataFrame, sifted: DataFrame) -> DataFrame:
    """(key, doc_id, start, data) of the segments that go on."""
    wanted = sifted.filter(F.col("kind") == SEGMENT).groupBy("doc_id").agg(F.collect_list("data").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wanted = b.column("doc_id").to_pylist(), b.column("data").to_pylist()
            for lo, hi, buf, offs in slices(b.column("text")):
                parts = [np.frombuffer(b"".join(x), _SEGMENT) for x in wanted[lo:hi]]
                n = [len(x) for x in parts]
                all_ = np.concatenate(parts)
                begin = all_["start"].astype(np.int64) + np.repeat(offs[:-1], n)
                size = all_["count"].astype(np.int64) + LENGTH - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                data = pa.Array.from_buffers(pa.binary(), len(all_), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buf[ragged(begin, size)])])
                yield pa.RecordBatch.from_arrays([pa.array(all_["key"].view(np.int64)), pa.array(np.repeat(ids[lo:hi], n).astype(np.int64)), pa.array(all_["start"].astype(np.int64)), data], names=["key", "doc_id", "start", "data"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "data").mapInArrow(run, "key long, doc_id long, start long, data binary")


def _merged(segments: DataFrame) -> DataFrame:
    """Spans of repeated windows, from transforms merged over the shards of runs of whole keys."""

    def spans(held: list[tuple]) -> pa.RecordBatch:
        doc, start = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        string, place = later_windows([(x[0], x[1]) for x in held], doc, start)
        at = start[string] + place
        rows = [(0, d, x) for d, x in _span_rows(doc[string], at, at + LENGTH)]
        return _row_batch(SPAN, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            keys, docs, starts = (b.column(c).to_numpy() for c in ("key", "doc_id", "start"))
            new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
            for lo, hi, buf, offs in slices(b.column("data"), SHARD_BYTES):
                at = lo
                if size >= MERGE_BYTES:  # what is held ends with the key it ends in
                    ahead = np.flatnonzero(new[lo:hi] & (keys[lo:hi] != last))
                    at = lo + int(ahead[0]) if len(ahead) else hi
                for i, j in ((lo, at), (at, hi)):
                    if i == at and size >= MERGE_BYTES and j > i:
                        yield spans(held)
                        held, size = [], 0
                    if j > i:
                        held.append((buf[offs[i - lo] : offs[j - lo]], np.diff(offs[i - lo : j - lo + 1]), docs[i:j], starts[i:j]))
                        size += int(offs[j - lo] - offs[i - lo])
                last = keys[hi - 1]
        if held:
            yield spans(held)

    return segments.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(run, _ROWS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, data): packed spans to remove, for the documents that have any."""
    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    sifted = materialise(_sifted(_keyed(known)), "sifted")
    merged = _merged(_bytes_of_segments(known, sifted))
    spans = sifted.filter(F.col("kind") == SPAN).select("doc_id", "data").unionByName(merged.select("doc_id", "data"))
    return spans.groupBy("doc_id").agg(F.collect_list("data").alias("data"))


def _spans(data: list[bytes] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(data or ()), _PAIR)
    return merge_spans(np.minimum(x["start"].astype(np.int64), size), np.minimum(x["end"].astype(np.int64), size))


def _kept(raw: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    at, parts = 0, []
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        parts.append(raw[at:s])
        at = e
    return b"".join([*parts, raw[at:]])


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the remaining bytes) of every row.

    Null text counts as empty. Rows without doc_id have no place in the order and keep everything. doc_id names a document:
    rows that repeat it are the same document again (with another text under the same doc_id, places are taken together and
    spans cut at each text's end).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, data in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("data").to_pylist(), strict=True):
                raw = raw or b""
                s, e = _spans(data, len(raw))
                out.append((len(raw), int((e - s).sum()), len(s), hashlib.sha256(_kept(raw, s, e)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_spans(docs)
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "data").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``, and ``n_chars`` counted anew; all rows stay.

    Spans are narrowed to whole characters, so texts stay valid; null text stays null.
    """
    names, found = docs.columns, unused(docs.columns, "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, data in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column(found).to_pylist(), strict=True):
                if raw is None or not data:
                    out.append(raw)
                    continue
                flat = np.frombuffer(raw, np.uint8)
                inner = np.append((flat & 0xC0) == 0x80, False)
                s, e = _spans(data, len(raw))
                for _ in range(3):
                    s, e = s + inner[s], e - inner[e]
                some = s < e
                out.append(_kept(raw, s[some], e[some]))
            columns = [pa.array(out, pa.binary()).cast(pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    spans = repeated_spans(docs).withColumnRenamed("data", found)
    cut = docs.join(spans, "doc_id", "left").select(*names, found).mapInArrow(run, docs.schema)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cut
