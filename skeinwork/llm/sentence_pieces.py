"""SentencePiece encoding and decoding by a relational lattice over the distinct words of a corpus.

A text becomes units that no piece spans: it is cut between two characters that no piece has side by side. Texts hold far
fewer different units than units, so workers first list the distinct ones. For each of those all substrings of bounded length
are exploded and joined to the piece table; the edges are grouped by unit, and a fold with ``aggregate`` over the places of
the unit keeps the best edge that ends there, from which the way back gives the ids. Characters without a piece become bytes.

* Models of scores (unigram): the best edge is the one with the largest sum of scores, as Viterbi decoding has it.
* Models of merges (BPE): no sum of scores gives what merging gives. A segmentation is what merging gives if no merge crosses
  a border between two of its pieces: a piece u at the end of the left one and a piece v at the start of the right one, with
  u + v a piece that ranks before the merges that used up u and v. Each piece carries its right and left spines for that: the
  lengths of such u and v, and those ranks. Exactly one edge that ends at a place fits the best edge where it starts.

Ids go back to the texts without a row for each word: units that occur often, at most ``TABLE_BYTES`` of them, are sent to all
workers; the ids of all others are joined to the texts that have them, by a digest of the text.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, unused, with_text
from .textkit import Hasher, char_offsets, ragged, slices, utf8

BLANK = "▁"
NEVER = 2**21 - 1
#: Bytes of ids of units that are sent to all workers; units that a task holds before it sends them on; the places that one step of the
#: outer fold takes; and the characters of a unit that are taken at once to find its edges.
TABLE_BYTES, MOST_HELD, BLOCK, WINDOW = 96 << 20, 1 << 17, 512, 64
#: Ids that are decoded and sent on at once.
MOST_IDS = 1 << 18
#: Distinct units whose lattices a task holds; their edges stay in memory when they are sorted.
UNITS_EACH = 1 << 14
UNIGRAM, MERGES = 1, 2
#: Kinds of pieces in a model file.
_NORMAL, _USER = 1, 4
#: What a character without a piece costs more than the worst piece, in models of scores.
_UNKNOWN = 10.0
#: A spine has (rank of the merge that uses a piece up << LENGTH_BITS) + its length, for the piece and what it ends or starts with.
_SPINE, LENGTH_BITS = "array<int>", 10
_EDGE = f"struct<start:int,id:int,rank:int,score:float,right:{_SPINE},left:{_SPINE}>"


@dataclass
class Vocabulary:
    kind: int
    rows: list[tuple]  # piece, id, rank, score, right spine, left spine
    zero: int  # the id of byte 0
    longest: int
    unknown: float  # score of a character without a piece
    classes: np.ndarray  # a number for each character that some piece has beside another one, else 0
    beside: np.ndarray  # whether some piece has characters of two classes side by side
    mark: int  # the id of one blank
    runs: dict[int, int]  # ids of pieces of several blanks, by length (models of merges only)


def _spines(plain: dict[str, tuple[int, float]]) -> list[tuple]:
    """Pieces that merges can form, with their spines on the right and on the left."""
    order = {piece: k for k, piece in enumerate(sorted(plain, key=lambda x: -plain[x][1]))}
    split: dict[str, tuple[str, str] | None] = {}
    for piece in sorted(plain, key=len):
        parts = list(piece)
        while len(parts) > 1:
            best = min(((order[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in order and len(a + b) < len(piece)), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        split[piece] = (parts[0], parts[1]) if len(parts) == 2 else None if len(parts) == 1 else ()

    def spine(piece: str, side: int) -> list[int]:
        out, limit = [], NEVER
        while True:
            out.append((limit << LENGTH_BITS) + len(piece))
            if not split[piece]:
                return out
            limit, piece = order[piece], split[piece][side]

    return [(p, plain[p][0], order[p], float(plain[p][1]), spine(p, 1), spine(p, 0)) for p in plain if split[p] != ()]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Reads a model. Those whose ids this lattice can't give are refused with a ValueError, never encoded some other way."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
    wrong = {
        "a model of words or characters": kind not in (UNIGRAM, MERGES), "pieces of users": any(p.type == _USER for p in proto.pieces),
        "no byte pieces": not proto.trainer_spec.byte_fallback, "blanks at ends of pieces": proto.trainer_spec.treat_whitespace_as_suffix,
        "a normalizer": bool(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces,
    }
    plain = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
    runs = {len(p): i for p, (i, _) in plain.items() if set(p) == {BLANK} and len(p) > 1} if kind == MERGES else {}
    if kind == MERGES:
        scores = {plain[BLANK * n][1] for n in runs}
        plain = {p: x for p, x in plain.items() if len(p) not in runs or set(p) != {BLANK}}
        wrong["blanks inside pieces"] = any(BLANK in p[1:] for p in plain)
        wrong["runs of blanks of several ranks"] = len(scores) > 1 or bool(scores) and min(s for p, (_, s) in plain.items() if len(p) > 1) <= max(scores)
    wrong["no piece for a blank"] = BLANK not in plain
    wrong["too many or too long pieces"] = len(plain) >= NEVER or max(map(len, plain), default=0) >= 1 << LENGTH_BITS
    if any(wrong.values()):
        raise ValueError("cannot encode by a lattice: " + ", ".join(k for k, v in wrong.items() if v))
    rows = _spines(plain) if kind == MERGES else [(p, i, 0, s, [], []) for p, (i, s) in plain.items()]
    pairs = {(a, b) for p in plain for a, b in zip(p, p[1:], strict=False)}
    chars = sorted({c for pair in pairs for c in pair})
    classes = np.zeros(0x110000, np.int32)
    classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for a, b in pairs:
        beside[classes[ord(a)], classes[ord(b)]] = True
    zero = next(i for i, p in enumerate(proto.pieces) if p.piece == "<0x00>")
    return Vocabulary(kind, rows, zero, max(map(len, plain)), min(s for _, s in plain.values()) - _UNKNOWN, classes, beside, plain[BLANK][0], runs)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary; its size is fixed by the model, so it may be broadcast."""
    return spark.createDataFrame(vocabulary(path).rows, f"piece string, id int, rank int, score float, right {_SPINE}, left {_SPINE}")


def units(buf: np.ndarray, offs: np.ndarray, v: Vocabulary) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, row) of the units of texts: blanks are marks, and one stands before each text that isn't empty."""
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    points[points == 32] = ord(BLANK)
    heads = char_offsets(buf)[offs]
    full = np.flatnonzero(np.diff(heads))
    begin = heads[:-1][full]
    points = np.insert(points, begin, ord(BLANK))
    begin = begin + np.arange(len(full))
    c = v.classes[points]
    cut = np.ones(len(points) + 1, bool)
    cut[1:-1] = ~v.beside[c[:-1], c[1:]]
    cut[begin] = True
    at = np.flatnonzero(cut)
    raw = points.tobytes().decode("utf-32-le").encode()
    place = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
    start, end = place[at[:-1]], place[at[1:]]
    return raw, start, end, full[np.searchsorted(begin, at[:-1], "right") - 1] if len(full) else np.zeros(0, np.int64)


@dataclass
class Distinct:
    """The distinct units among some places of a buffer."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]
    n: np.ndarray  # how often each occurs
    number: np.ndarray  # the unit of each place

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].decode()

    def texts(self) -> list[str]:
        return [self.raw[s:e].decode() for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def distinct_units(raw: bytes, start: np.ndarray, end: np.ndarray) -> Distinct:
    h, g = Hasher(np.frombuffer(raw, np.uint8)).pairs(start, end)
    _, first, number, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    if not (g[first][number] == g).all():  # two units share one of the two hashes
        _, first, number, n = np.unique(np.stack([h, g], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return Distinct(raw, start[first], end[first], (h[first], g[first]), n, number.ravel())


def unit_key(unit: str) -> str:
    """What names a unit in tables: itself, or a digest if it is long (only that begins with a zero and goes on)."""
    return unit if len(unit) <= WINDOW else "\0" + text_key(unit)


def corpus_units(docs: DataFrame, path: str) -> DataFrame:
    """(key, base, part, n) of the distinct units of all texts; a task sends a unit once, unless it holds too many.

    A long unit comes in parts of ``WINDOW`` characters from ``base`` on, with as many more as a piece may take.
    """
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    names = ["key", "base", "part", "n"]

    def rows(held: dict[str, int], reach: int) -> pa.RecordBatch:
        out = []
        for unit, n in held.items():
            if len(unit) <= WINDOW:
                out.append((unit, 0, None, n))
            else:
                key = unit_key(unit)
                out += [(key, lo, unit[lo : lo + WINDOW + reach], n) for lo in range(0, len(unit), WINDOW)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held = vocabulary(path), {}
        for b in batches:
            for _, _, buf, offs in slices(b.column(0)):
                found = distinct_units(*units(buf, offs, v)[:3])
                for unit, k in zip(found.texts(), found.n.tolist(), strict=True):
                    held[unit] = held.get(unit, 0) + k
                if len(held) >= MOST_HELD:
                    yield rows(held, v.longest - 1)
                    held.clear()
        yield rows(held, v.longest - 1)

    sent = docs.select("text").filter("text <> ''").mapInArrow(run, "key string, base int, part string, n long")
    found = materialise(sent.groupBy("key", "base", "part").agg(F.sum("n").alias("n")), "distinct")
    return found.repartition(max(1, math.ceil(found.count() / UNITS_EACH)), "key")


@contextlib.contextmanager
def grouped_in_order(spark: SparkSession) -> Iterator[None]:
    """Plans made in this block group rows that are sorted by the key one after the other, without a table of groups."""
    name = "spark.sql.execution.replaceHashWithSortAgg"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def lattice(words: DataFrame, pieces: DataFrame, longest: int, unknown: float = 0.0) -> DataFrame:
    """(key, n, ends): for each place of a unit the edges that end there, the longest first.

    ``id`` of an edge for a character without a piece is -1 less its code point. Rows of a unit stay where ``words`` put
    them, so neither grouping here moves anything; units are sorted and their edges made in order of places, so sorting
    edges finds them in order (in ``grouped_in_order`` that is all that grouping needs).
    """
    part = words.select("key", "n", "base", F.coalesce("part", "key").alias("part")).sortWithinPartitions("key", "n", "base")
    last = F.least(F.lit(WINDOW + longest - 1), F.length("part"))
    at = part.select("*", F.explode(F.sequence(F.lit(1), last)).alias("last"))
    cut = at.select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("last") - longest + 1), F.least(F.lit(WINDOW), F.col("last")))).alias("first"))
    length = F.col("last") - F.col("first") + 1
    cut = cut.select("key", "n", (F.col("base") + F.col("first") - 1).alias("start"), length.alias("len"), F.substring("part", F.col("first"), length).alias("piece"))
    found = cut.join(F.broadcast(pieces), "piece", "left").filter("id IS NOT NULL OR len = 1")
    alone = F.array(F.lit((NEVER << LENGTH_BITS) + 1))
    edge = F.struct(
        "start", F.coalesce("id", -1 - F.ascii("piece")).alias("id"), F.coalesce("rank", F.lit(NEVER)).alias("rank"),
        F.coalesce("score", F.lit(unknown).cast("float")).alias("score"), F.coalesce("right", alone).alias("right"), F.coalesce("left", alone).alias("left"),
    ).cast(_EDGE)
    edges = found.select("key", "n", (F.col("start") + F.col("len")).alias("end"), edge.alias("edge")).sortWithinPartitions("key", "n", "end", "edge.start")
    ends = edges.groupBy("key", "n", "end").agg(F.sort_array(F.collect_list("edge")).alias("edges")).sortWithinPartitions("key", "n", "end")
    places = F.sort_array(F.collect_list(F.struct("end", "edges")))
    return ends.groupBy("key", "n").agg(F.transform(places, lambda x: x["edges"]).alias("ends"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segment(rows: DataFrame, kind: int, longest: int) -> DataFrame:
    """(key, n, ids) from (key, n, ends): the fold over places, then the way back.

    The fold looks back at the last ``longest`` places only, and what it keeps for the way back grows by blocks: both are
    linear in a unit's length. Ids below zero stand for code points, see ``lattice``.
    """
    keeps, kept = ("total", "float") if kind == UNIGRAM else ("right", _SPINE)
    place = f"struct<{keeps}:{kept},start:int,id:int>"

    def by_score(edges: Column, before) -> Column:
        def better(acc: Column, e: Column) -> Column:
            total = F.when(e["start"] == 0, e["score"]).otherwise(before(e) + e["score"]).cast("float")
            return _once(total, lambda t: F.when(acc.isNull() | (acc["total"] < t), F.struct(t.alias("total"), e["start"].alias("start"), e["id"].alias("id"))).otherwise(acc))

        return F.aggregate(edges, F.lit(None).cast(place), better)

    def by_merges(edges: Column, before) -> Column:
        def crossed(e: Column) -> Column:
            border = e["start"]
            until, length = lambda x: F.shiftright(x, LENGTH_BITS), lambda x: x.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
            merge = lambda v, x: (x["start"] < border) & (x["rank"] <= until(v)) & F.exists(before(e), lambda r: (length(r) == border - x["start"]) & (x["rank"] < until(r)))
            return F.exists(e["left"], lambda v: F.exists(F.get(F.col("ends"), border + length(v) - 1), lambda x: merge(v, x)))

        fits = lambda acc, e: F.when(acc.isNotNull(), acc).when((e["start"] == 0) | ~crossed(e), F.struct(e["right"].alias("right"), e["start"].alias("start"), e["id"].alias("id")))
        return F.aggregate(edges, F.lit(None).cast(place), fits)

    best = by_score if kind == UNIGRAM else by_merges
    blocks = F.ceil(F.size("ends") / BLOCK).cast("int")
    held = lambda k: F.least(k * BLOCK, F.lit(longest))  # noqa: E731 (how many places before its own a block knows)

    def block(state: Column, k: Column) -> Column:
        before = lambda bests: lambda e: F.get(bests, e["start"] - 1 - k * BLOCK + held(k))[keeps]
        inner = F.aggregate(F.slice("ends", k * BLOCK + 1, F.lit(BLOCK)), state["window"], lambda bests, edges: F.array_append(bests, best(edges, before(bests))))
        window = lambda bests: F.slice(bests, F.greatest(F.lit(1), F.size(bests) - longest + 1), F.lit(longest))
        return _once(inner, lambda b: F.struct(window(b).alias("window"), F.array_append(state["parts"], F.slice(b, held(k) + 1, F.lit(BLOCK))).alias("parts")))

    begin = F.struct(F.array().cast(f"array<{place}>").alias("window"), F.array().cast(f"array<array<{place}>>").alias("parts"))
    walked = F.aggregate(F.sequence(F.lit(0), blocks - 1), begin, block, lambda s: s["parts"])

    def hop(acc: Column, i: Column, part: Column) -> Column:
        here = F.get(part, (i - 1) % BLOCK)
        return F.when(acc["at"] == i, F.struct(here["start"].alias("at"), F.array_append(acc["path"], here["id"]).alias("path"))).otherwise(acc)

    def way_back(parts: Column) -> Column:
        def back(acc: Column, k: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("path"))
            places = F.sequence(F.least(F.size("ends"), (k + 1) * BLOCK), k * BLOCK + 1, F.lit(-1))
            inner = F.aggregate(places, start, lambda a, i: hop(a, i, F.get(parts, k)))
            return _once(inner, lambda s: F.struct(s["at"].alias("at"), F.array_append(acc["paths"], s["path"]).alias("paths")))

        end = F.struct(F.size("ends").alias("at"), F.array().cast("array<array<int>>").alias("paths"))
        return F.aggregate(F.sequence(blocks - 1, F.lit(0), F.lit(-1)), end, back, lambda s: s["paths"])

    return rows.select("key", "n", F.reverse(F.flatten(_once(walked, way_back))).alias("ids"))


@functools.lru_cache(maxsize=4096)
def blank_run(n: int, lengths: frozenset[int]) -> tuple[int, ...]:
    """Lengths of the pieces of n blanks. All merges of blanks rank the same, so the leftmost goes first: a fold from the left."""
    out: list[int] = []
    for _ in range(n):
        out.append(1)
        while len(out) > 1 and out[-2] + out[-1] in lengths:
            out[-2:] = [out[-2] + out[-1]]
    return tuple(out)


def join_blanks(ids: np.ndarray, row: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids with blanks that stand alone side by side merged (they come last, and only with each other), and their rows."""
    lone = ids == v.mark
    if not v.runs or not (lone[1:] & lone[:-1]).any():
        return ids, row
    opens = lone & np.concatenate([[True], ~lone[:-1] | (row[1:] != row[:-1])])
    starts = np.flatnonzero(opens)
    closes = lone & np.concatenate([~lone[1:] | (row[1:] != row[:-1]), [True]])
    size = np.flatnonzero(closes) - starts + 1
    keep = np.ones(len(ids), bool)
    ids = ids.copy()
    lengths = frozenset(v.runs)
    for s, n in zip(starts[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        parts = [v.runs.get(k, v.mark) for k in blank_run(n, lengths)]
        ids[s : s + len(parts)] = parts
        keep[s + len(parts) : s + n] = False
    return ids[keep], row[keep]


def spell_out(ids: np.ndarray, row: np.ndarray, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the bytes of a code point for each one below zero, and their rows."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, row
    points, number = np.unique(-1 - ids[odd], return_inverse=True)
    raw = [chr(p).encode() for p in points.tolist()]
    size = np.ones(len(ids), np.int64)
    size[odd] = np.array([len(x) for x in raw])[number]
    out, first = np.repeat(ids, size), np.cumsum(size) - size
    out[ragged(first[odd], size[odd])] = np.frombuffer(b"".join(raw[k] for k in number.tolist()), np.uint8).astype(np.int32) + zero
    return out, np.repeat(row, size)


class Table:
    """Ids of units in order of two hashes of their keys, which take the keys' place."""

    def __init__(self, h: np.ndarray, g: np.ndarray, size: np.ndarray, ids: np.ndarray):
        order = np.lexsort((g, h))
        self.h, self.g = h[order], g[order]
        self.ids = ids[ragged((np.cumsum(size) - size)[order], size[order])]
        self.ends = np.concatenate([[0], np.cumsum(size[order])]).astype(np.int64)

    def find(self, units: Distinct) -> np.ndarray:
        """The place of each unit, or -1."""
        h, g = units.hashes
        long = np.flatnonzero(units.end - units.start > WINDOW)
        if len(long):  # these go by a digest if they have more characters than that
            keys = [unit_key(units.text(i)).encode() for i in long.tolist()]
            ends = np.cumsum([len(k) for k in keys])
            h, g = h.copy(), g.copy()
            h[long], g[long] = Hasher(np.frombuffer(b"".join(keys), np.uint8)).pairs(np.append(0, ends[:-1]), ends)
        at = np.searchsorted(self.h, h)
        while True:  # on, past others with the same first hash
            here = np.minimum(at, max(0, len(self.h) - 1))
            there = at < len(self.h)
            same = there & (self.h[here] == h) if len(self.h) else there
            on = same & (self.g[here] != g) if len(self.h) else there
            if not on.any():
                return np.where(same, at, -1)
            at = at + on


_PACKED = "h binary, g binary, size binary, ids binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ids) rows as hashes of the keys, numbers of ids, and ids, a row for each batch."""
    for b in batches:
        buf, offs = utf8(b.column(0))
        h, g = Hasher(buf).pairs(offs[:-1], offs[1:])
        lists = b.column(1)
        packed = (h, g, np.diff(lists.offsets.to_numpy()).astype(np.int32), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], names=["h", "g", "size", "ids"])


def _frequent(coded: DataFrame) -> tuple[Table, bool]:
    """The table of the units that occur often, ``TABLE_BYTES`` of them at most, and whether there are others."""
    band = F.floor(F.log2("n")).cast("int")
    sizes = dict(coded.groupBy(band.alias("band")).agg(F.sum(20 + 4 * F.size("ids"))).collect())
    held, least = 0, max(sizes, default=0) + 1
    while least > 0 and held + sizes.get(least - 1, 0) <= TABLE_BYTES:
        least -= 1
        held += sizes.get(least, 0)
    rows = coded.filter(band >= least).select("key", "ids").mapInArrow(_pack, _PACKED).toArrow()
    whole = [np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("h", np.uint64), ("g", np.uint64), ("size", np.int32), ("ids", np.int32))]
    del rows
    return Table(*whole), least > 0


def _rare(docs: DataFrame, table, path: str) -> DataFrame:
    """(text_key, key) of the units of each text that the table hasn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(path), table.value
        for b in batches:
            column = b.column(0)
            for lo, hi, buf, offs in slices(column):
                raw, start, end, row = units(buf, offs, v)
                found = distinct_units(raw, start, end)
                other = known.find(found) < 0
                some = other[found.number] if len(found.number) else np.zeros(0, bool)
                pairs = np.unique((row[some].astype(np.int64) << 32) | found.number[some])
                keys = [text_key(t) for t in column.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in (pairs >> 32).tolist()], pa.string()), pa.array([unit_key(found.text(i)) for i in (pairs & 0xFFFFFFFF).tolist()], pa.string())], names=["text_key", "key"])

    return docs.select("text").filter("text <> ''").mapInArrow(run, "text_key string, key string").distinct()


def text_key(text: str) -> str:
    """A digest that only finds what belongs to a text; the same as Spark's ``md5``."""
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def _encoding(docs: DataFrame, path: str, keep: tuple[str, ...]) -> tuple[DataFrame, Callable, T.StructType]:
    """Rows, what turns batches of them into batches of ``keep`` columns and ids, and the schema of those; see ``encode``."""
    spark, v = docs.sparkSession, vocabulary(path)
    edges = lattice(corpus_units(docs, path), piece_table(spark, path), v.longest, v.unknown)
    with grouped_in_order(spark):
        coded = materialise(segment(edges, v.kind, v.longest), "units")
    frequent, others = _frequent(coded)
    table = spark.sparkContext.broadcast(frequent)
    schema = docs.select(*keep).schema
    schema = schema.add(unused(keep, "ids"), T.ArrayType(T.IntegerType()))
    rows, at = with_text(docs, keep)
    if others:
        found = _rare(docs, table, path).join(coded.select("key", "ids"), "key")
        found = found.groupBy("text_key").agg(F.collect_list(F.struct("key", "ids")).alias("own"))
        own, key = unused(rows.columns, "own"), unused(rows.columns, "text_key")
        found = found.select(F.col("text_key").alias(key), F.col("own").alias(own)).hint("shuffle_hash")
        rows = rows.withColumn(key, F.md5(F.col("text").cast("binary"))).join(found, key, "left").select(*rows.columns, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for lo, hi, buf, offs in slices(b.column(at)):
                raw, start, end, row = units(buf, offs, v)
                found = distinct_units(raw, start, end)
                number = found.number
                ids, n = _ids_of(found, table.value, b.column(b.num_columns - 1).slice(lo, hi - lo).to_pylist() if others else [])
                begin = np.cumsum(n) - n
                whole = ids[ragged(begin[number], n[number])] if len(number) else np.zeros(0, np.int32)
                whole, row = join_blanks(*spell_out(whole, np.repeat(row, n[number]), v.zero), v)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[: len(keep)]), pa.ListArray.from_arrays(pa.array(ends), pa.array(whole, pa.int32()))], names=schema.names)

    return rows, run, schema


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids array<int> of every row's whole text: the ids of the model, without begin or end.

    Null and empty texts have no ids; repeated rows have equal ids; an empty table gives no rows. Where ``keep`` has a column
    ids, the new one is called ids_ (see ``unused``). Work and memory are linear in the length of a text, of a word, and of a
    run of blanks. A model that is no unigram or merging one, or that normalizes texts, is refused.
    """
    rows, run, schema = _encoding(docs, path, keep)
    return rows.mapInArrow(run, schema)


def _ids_of(found: Distinct, table: Table, own: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids of some units, number of each), from the table and from what came with the texts."""
    at, ids, ends = table.find(found), table.ids, table.ends
    lost = np.flatnonzero(at < 0)
    if len(lost):
        more = {x["key"]: x["ids"] for some in own for x in some or ()}
        extra = [more[unit_key(found.text(i))] for i in lost.tolist()]
        at[lost] = len(ends) - 1 + np.arange(len(lost))
        ends = np.concatenate([ends, ends[-1] + np.cumsum([len(x) for x in extra])])
        ids = np.concatenate([ids, *[np.array(x, np.int32) for x in extra]])
    n = ends[at + 1] - ends[at]
    return ids[ragged(ends[at], n)], n


def _decoding(path: str, at: int, kept: int, names: list[str]) -> Callable:
    """What turns batches with ids in column ``at`` into batches of the first ``kept`` columns and texts; see ``decode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        zero = model.piece_to_id("<0x00>")
        pieces = [bytes([i - zero]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(BLANK, " ").encode() for i in range(model.get_piece_size())]
        size = np.array([len(p) for p in pieces])
        flat, begin = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        for b in batches:
            column = b.column(at)
            values, ends, there = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            first = 0
            while first < b.num_rows:  # on, by MOST_IDS ids or one row of more
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + MOST_IDS, "right")) - 1)
                texts = []
                for i in range(first, last):
                    own = values[ends[i] : ends[i + 1]] if there[i] else values[:0]
                    raw = flat[ragged(begin[own], size[own])].tobytes()
                    texts.append(raw.removeprefix(b" ").decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in b.columns[:kept]), pa.array(texts, pa.string())], names=names)
                first = last

    return run


def decode(coded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and the text of ``ids`` array<int>: bytes of all pieces together, marks as blanks, without the first one.

    Null and empty ids give the empty text, and so do control pieces; bytes that are no text become replacement characters;
    repeated rows give equal texts; an empty table gives no rows. ``keep`` may have the ids; where it has a column text, the
    new one is called text_ (see ``unused``).
    """
    schema = coded.select(*keep).schema
    schema = schema.add(unused(keep, "text"), "string")
    rows, at = with_text(coded, keep, ids)
    return rows.mapInArrow(_decoding(path, at, len(keep), schema.names), schema)


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids and the text decoded from them: ``decode`` of ``encode``, in the workers that encode.

    So no second worker stands beside each of those, and ids are sent to the JVM once and not back.
    """
    rows, run, coded = _encoding(docs, path, keep)
    schema = T.StructType([*coded.fields, T.StructField(unused(coded.names, "text"), T.StringType())])
    back = _decoding(path, len(keep), len(coded.names), schema.names)
    return rows.mapInArrow(lambda batches: back(run(batches)), schema)
