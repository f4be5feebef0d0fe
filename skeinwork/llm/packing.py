"""Best-fit packing of token sequences into windows of a fixed capacity.

Bounded-space online best fit: at most ``open_bins`` bins are open; the amounts of free space that occur among them are
the set bits of one integer, so the tightest bin that takes an item is the lowest set bit at or above its length. When an
item fits nowhere and no more bins may be opened, the fullest bin closes.

Each partition packs its own items. Bins that are still open when a partition ends and aren't nearly full are unpacked,
and their items packed again in fewer, larger partitions, so the waste at partition ends doesn't grow with their number.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, unused, with_text
from .textkit import ragged, slices
from .token_counts import segment_table

CAPACITY, OPEN_BINS = 4096, 1024
#: Bins a packing partition fills, about; and the share of the capacity that a bin left open may lack and still count as full.
BINS_EACH, NEARLY = 4096, 0.02


class BestFit:
    """Places items one by one; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most, self.free_bits, self.n_open, self.made = capacity, open_bins, 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"an item of {length} does not fit {self.capacity}")
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            free = self.capacity
            if length < free and self.n_open == self.most:  # the fullest closes
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            which = self.made
            self.made += 1
        if free > length:
            self.by_free[free - length].append(which)
            self.free_bits |= 1 << (free - length)
            self.n_open += 1
        return which, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        which = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return which

    def left_open(self) -> dict[int, int]:
        """bin -> free space."""
        return {b: free for free, bins in self.by_free.items() for b in bins}


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of each text and then ``end_id``, cut into pieces of ``capacity`` (the last may be shorter).

    Returns ``keep``, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, on request, ids. Null text
    counts as empty and gives one piece that holds only ``end_id``; repeated rows give repeated pieces.
    """
    schema = df.select(*keep).schema
    for c, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(unused(schema.names, c), kind)
    if with_ids:
        schema = schema.add(unused(schema.names, "ids"), T.ArrayType(T.LongType()))

    rows, at = with_text(df, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segment_table(path)
        for b in batches:
            for lo, hi, buf, offs in slices(b.column(at)):
                ids, n = table.encoded(buf, offs)
                laid = np.full(len(ids) + len(n), end_id, "<u4")  # each text's ids and then the end
                laid[ragged(np.cumsum(n + 1) - n - 1, n)] = ids
                pieces = -(-(n + 1) // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = ragged(np.zeros(len(n), np.int64), pieces)
                start = piece * capacity
                length = np.minimum(capacity, (n + 1)[row] - start)
                begin = (np.cumsum(n + 1) - n - 1)[row] + start
                raw = memoryview(laid.tobytes())
                crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [c.slice(lo, hi - lo).take(pa.array(row)) for c in b.columns[: len(keep)]] + [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([laid[s : s + k].astype(np.int64) for s, k in zip(begin.tolist(), length.tolist(), strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _pack_once(items: DataFrame, length: str, capacity: int, open_bins: int, partitions: int, level: int) -> DataFrame:
    names = items.columns
    schema = items.schema
    for name, kind in (("sequence_id", "long"), ("offset", "long"), ("__open", "boolean")):
        schema = schema.add(unused(names, name), kind)
    place = unused(names, "__order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, held, bins, offsets = BestFit(capacity, open_bins), [], [], []
        for b in batches:
            held.append(pa.RecordBatch.from_arrays([b.column(c) for c in names], names=names))
            for n in b.column(length).to_pylist():
                which, offset = packer.place(n)
                bins.append(which)
                offsets.append(offset)
        short = {b for b, free in packer.left_open().items() if free > NEARLY * capacity}
        at, base = 0, (level << 60) | (part << 36)
        for b in held:
            some = bins[at : at + b.num_rows]
            columns = [*b.columns, pa.array([base + x for x in some], pa.int64()), pa.array(offsets[at : at + b.num_rows], pa.int64()), pa.array([x in short for x in some], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            at += b.num_rows

    order = F.xxhash64(*names)
    return items.withColumn(place, order).repartition(partitions, place).sortWithinPartitions(place, *names).mapInArrow(run, schema)


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``items`` with sequence_id (any distinct numbers) and offset: each item whole in one sequence, gapless from 0.

    ``length`` must be from 1 to ``capacity`` (else the job fails); other columns are carried along and may hold nulls;
    repeated rows are separate items; an empty table gives no rows. Where ``items`` has a column sequence_id or offset, the
    new one has underscores after that (see ``unused``). A packing partition holds about ``BINS_EACH`` bins'
    worth of (id, length) rows, whatever the size of the input.
    """
    kept = materialise(items, "pieces")

    def partitions(df: DataFrame) -> int:
        total = df.agg(F.coalesce(F.sum(length), F.lit(0)).cast("long")).first()[0]
        return max(1, math.ceil(total / (capacity * BINS_EACH)))

    first = materialise(_pack_once(kept, length, capacity, open_bins, partitions(kept), 0), "packed")
    left = unused(items.columns, "__open")
    rest = first.filter(F.col(left)).select(*items.columns)
    second = _pack_once(rest, length, capacity, open_bins, partitions(rest), 1)
    return first.filter(~F.col(left)).drop(left).unionByName(second.drop(left))


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenizes, cuts and packs whole texts; see ``token_pieces`` and ``pack``."""
    return pack(token_pieces(df, path, capacity), "length", capacity, open_bins)
