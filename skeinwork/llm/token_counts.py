"""Token counts: encoding in Arrow batches that returns lengths only.

Texts are taken in slices of bounded bytes and split at safe boundaries: a tokenizer that drops white space before it forms
words has no token, merge or special string that spans a blank or a line feed, nor one that spans the border between an ASCII
letter and plain punctuation, so the segments between such borders can be encoded apart and put together again; those of
letters alone are the same in either case. Segments repeat, so each worker keeps a bounded table of them, by 128-bit hash; the segments
that a slice adds are encoded in joined batches of bounded bytes. For other tokenizers (``boundaries=False``) whole texts
are encoded.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import with_text, unused
from .textkit import LOWER, Hasher, Runs, mix, ragged, slices

SLOT_BITS, MOST_IDS, JOINED_BYTES = 20, 1 << 22, 1 << 15
#: Segments that are looked up at once; all may differ, and they fill half of the table then.
GROUP = 1 << (SLOT_BITS - 1)
MARK = "\x02"
#: 0: between segments; 1: letters; 2: punctuation that begins no contraction or special string; 3: whatever else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x0A]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 2


class Segments(Runs):
    """Runs of one text that can be encoded apart, and ``plain``: whether each is of ASCII letters alone."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        kind = np.zeros(len(buf) + 2, np.uint8)
        kind[1:-1] = _CLASS[buf]
        border = (kind[1:] ^ kind[:-1]) == 3  # letters and punctuation, or others and none
        border |= (kind[1:] == 0) | (kind[:-1] == 0)
        border[offs] = True
        self.start = np.flatnonzero(border[:-1] & (kind[1:-1] > 0))
        self.end = np.flatnonzero(border[1:] & (kind[1:-1] > 0)) + 1
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.buf, self.offs = buf, offs
        odd = np.concatenate([[0], np.cumsum(kind[1:-1] != 1, dtype=np.int32)])
        self.plain = odd[self.end] == odd[self.start]

    def groups(self) -> Iterator[tuple[np.ndarray, Segments]]:
        """(bytes, segments of them) of GROUP segments at a time, in order; rows keep their numbers."""
        for lo in range(0, len(self.start), GROUP):
            part, own = copy(self), slice(lo, lo + GROUP)
            at, end = int(self.start[lo]), int(self.end[own][-1])
            part.buf, part.start, part.end, part.row, part.plain = self.buf[at:end], self.start[own] - at, self.end[own] - at, self.row[own], self.plain[own]
            yield part.buf, part


def load_tokenizer(path: str):
    """A function from texts to lists of ids, for .json or .model files; one thread, no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


class SegmentTable:
    """Ids of segments by hash: open addressing, emptied when it is half full or holds ``MOST_IDS`` ids."""

    def __init__(self, path: str):
        self.encode = load_tokenizer(path)
        mark = self.encode([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.folds = self.encode(["Ab ZQ xY"]) == self.encode(["ab zq xy"])
        self.keys, self.others = np.empty(1 << SLOT_BITS, np.uint64), np.empty(1 << SLOT_BITS, np.uint64)
        self.start, self.length = np.empty(1 << SLOT_BITS, np.int64), np.empty(1 << SLOT_BITS, np.int32)
        self.ids = np.empty(1 << 16, np.uint32)
        self.clear()

    def clear(self) -> None:
        self.keys.fill(0)
        self.n, self.used = 0, 0

    def _find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Slot of each pair of hashes, or of the free slot where it would go, as -1 - slot."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.empty(len(h), np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            there = self.keys[slot]
            hit, free = (there == h) & (self.others[slot] == g), there == 0
            out[open_[hit]] = slot[hit]
            out[open_[free]] = -1 - slot[free]
            more = ~(hit | free)
            open_, h, g, slot = open_[more], h[more], g[more], (slot[more] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _encode(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of each segment, encoded many at once with marks between them."""
        out: list[np.ndarray] = [None] * len(segments)
        plain = [i for i, s in enumerate(segments) if MARK not in s] if self.mark is not None else []
        odd = sorted(set(range(len(segments))) - set(plain))
        for i, ids in zip(odd, self.encode([segments[i] for i in odd]) if odd else (), strict=True):
            out[i] = np.array(ids, np.uint32)
        lo = 0
        while lo < len(plain):
            hi, size = lo, 0
            while hi < len(plain) and (hi == lo or size < JOINED_BYTES):
                size += len(segments[plain[hi]]) + 3
                hi += 1
            ids = np.array(self.encode([f" {MARK} ".join(segments[i] for i in plain[lo:hi])])[0], np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.mark))
            for k, i in enumerate(plain[lo:hi]):
                out[i] = parts[k][1:] if k else parts[k]
            lo = hi
        return out

    def slots(self, buf: np.ndarray, runs: Segments) -> np.ndarray:
        """The slot of each segment; valid until the next call."""
        h, g = Hasher(buf, LOWER if self.folds else None).pairs(runs.start, runs.end)
        if self.folds:
            other = np.flatnonzero(~runs.plain)
            for lane, own in zip((h, g), Hasher(buf).pairs(runs.start[other], runs.end[other]), strict=True):
                lane[other] = mix(own + np.uint64(1))
        h = np.maximum(h, np.uint64(1))
        found = self._find(h, g)
        new = np.flatnonzero(found < 0)
        if len(new):
            first = new[_firsts(h[new], g[new])]
            if self.n + len(first) > 1 << (SLOT_BITS - 1) or self.used > MOST_IDS:
                self.clear()
                first = _firsts(h, g)
            raw = buf.tobytes()
            values = self._encode([raw[s:e].decode() for s, e in zip(runs.start[first].tolist(), runs.end[first].tolist(), strict=True)])
            length = np.array([len(v) for v in values], np.int64)
            while self.used + length.sum() > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
            self.ids[self.used : self.used + length.sum()] = np.concatenate(values)
            begin = self.used + np.cumsum(length) - length
            self.used += int(length.sum())
            self.n += len(first)
            left, keys, others = np.arange(len(first)), h[first], g[first]
            while len(left):  # of those that want the same free slot one gets it, and the others look on
                slot = -1 - self._find(keys[left], others[left])
                _, one = np.unique(slot, return_index=True)
                take = left[one]
                at = slot[one]
                self.keys[at], self.others[at], self.start[at], self.length[at] = keys[take], others[take], begin[take], length[take]
                left = np.delete(left, one)
            found = self._find(h, g)
        return found

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        n = np.zeros(len(offs) - 1, np.int64)
        for part, runs in Segments(buf, offs).groups():
            n += np.bincount(runs.row, self.length[self.slots(part, runs)], len(n)).astype(np.int64)
        return n

    def encoded(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        ids, n = [np.zeros(0, np.uint32)], np.zeros(len(offs) - 1, np.int64)
        for part, runs in Segments(buf, offs).groups():
            slots = self.slots(part, runs)
            length = self.length[slots].astype(np.int64)
            ids.append(self.ids[ragged(self.start[slots], length)])
            n += np.bincount(runs.row, length, len(n)).astype(np.int64)
        return np.concatenate(ids), n


def _firsts(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where each distinct pair of hashes occurs, once."""
    order = np.lexsort((g, h))
    new = (np.diff(h[order], prepend=~h[order[:1]]) != 0) | (np.diff(g[order], prepend=~g[order[:1]]) != 0)
    return order[new]


_tables: dict[str, SegmentTable] = {}


def segment_table(path: str) -> SegmentTable:
    """This worker's table for a tokenizer; later tasks of the worker go on with it."""
    if path not in _tables:
        _tables[path] = SegmentTable(path)
    return _tables[path]


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, boundaries: bool | None = None) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    No shuffle: one pass over the scanned partitions, only lengths leave the workers. Null text counts as empty (0 bytes,
    0 tokens); repeated rows give repeated results; an empty table gives no rows; other columns are not read. Names that
    ``keep`` has get an underscore. Texts are split at safe ``boundaries`` unless the file is a ``.model``, which has none.
    """
    boundaries = not path.endswith(".model") if boundaries is None else boundaries
    schema = df.select(*keep).schema
    for c, kind in (("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")):
        schema = schema.add(unused(schema.names, c), kind)
    rows, at = with_text(df, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None if boundaries else load_tokenizer(path)
        for b in batches:
            column, parts = b.column(at), []
            for lo, hi, buf, offs in slices(column):
                parts.append(segment_table(path).counts(buf, offs) if boundaries else np.array([len(x) for x in encode([t or "" for t in column.slice(lo, hi - lo).to_pylist()])]))
            n = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            size = pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], size, pa.array(n), pa.array(n > limit)], names=schema.names)

    return rows.mapInArrow(run, schema)
