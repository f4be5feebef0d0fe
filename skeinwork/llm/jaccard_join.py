"""N-gram Jaccard self-join by chosen paths.

A text is the set of its word shingles. Sets are embedded as ``TOKENS`` min-wise sampled tokens, and split recursively: a
node of the tree picks sampled positions, and sets that share the tokens at two of them fall into the same child. Small
nodes are compared by brute force. In a larger node every set is compared with the node's hub, the sets very close to
that are done (whatever is near them is near the hub too), and the rest is split further, until nothing is left. Runs
are repeated: ``runs`` follows from the recall wanted.

Nodes yield links between likely pairs that hold each group together, not all its pairs. The texts of a group of candidates
then meet, in blocks, and exact similarities decide who is linked: the number of links and the final groups come from those.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import components
from .shared import materialise, unused
from .textkit import Hasher, Runs, mix, ragged, slices, windows

WORDS, TOKENS = 5, 64
NUM, DEN = 4, 5  # a similarity of 4/5 or more is a link
SMALL, BLOCK = 128, 1024
#: Estimates at which a pair counts as likely, at which a set is linked to its node's hub, and at which it is so close to the
#: hub that it is done: any set linked to it is then near the hub as well, by the triangle inequality of distances.
LIKELY, NEAR_HUB, CLOSE = 0.6, 0.42, 0.7
RECALL, DEPTH = 0.9995, 2
#: How many nodes, of all, have a second child for each set: with 1 / similarity ** 2 children a pair at the threshold keeps one on average.
SECOND = (DEN / NUM) ** 2 - 1
_rng = np.random.Generator(np.random.PCG64(808))
_A = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, TOKENS, dtype=np.uint64)


def runs_needed(recall: float = RECALL, similarity: float = NUM / DEN, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met, with that probability, in a node so many splits below the first."""
    child = similarity**2
    met = similarity * (child + (1 - child) * SECOND * child) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; a shorter text with a word has one, of all its words."""
    runs = Runs(buf, offs)
    h = Hasher(buf).strong(runs.start, runs.end)
    grams, first = windows(h, runs.row, words)
    n = np.diff(runs.bounds())
    lows = runs.bounds()
    at = np.searchsorted(runs.row[first], np.arange(len(offs))) if len(first) else np.zeros(len(offs), np.int64)
    out = []
    for i in range(len(offs) - 1):
        if n[i] >= words:
            out.append(np.unique(grams[at[i] : at[i + 1]]))
        elif n[i]:
            value = np.uint64(n[i])
            for x in h[lows[i] : lows[i + 1]]:
                value = mix(np.array([value]) * np.uint64(0xD6E8FEB86659FD93) + x)[0]
            out.append(np.array([value], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sample_tokens(s: np.ndarray) -> np.ndarray:
    """The ``TOKENS`` min-wise tokens of a set that isn't empty."""
    low = np.full(TOKENS, 2**32 - 1, np.uint64)
    for lo in range(0, len(s), 4096):
        low = np.minimum(low, ((s[lo : lo + 4096, None] * _A + _B) >> np.uint64(32)).min(0))
    return low.astype(np.uint32)


def _key(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set of shingles; None if it is empty."""
    return np.array([s.sum(), mix(s).sum()], np.uint64).tobytes() if len(s) else None


def _keyed(docs: DataFrame, words: int, name: str = "__key") -> DataFrame:
    """``docs`` with the key of each text's set as ``name``."""
    names = [*docs.columns, name]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(s) for _, _, buf, offs in slices(b.column(at)) for s in shingle_sets(buf, offs, words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, tokens = [], []
            for _, _, buf, offs in slices(b.column("text")):
                for s in shingle_sets(buf, offs, words):
                    keys.append(_key(s))
                    tokens.append(sample_tokens(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], names=["doc_id", "key", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, tokens binary")


def _matrix(column: pa.Array) -> np.ndarray:
    buf, _ = _raw(column)
    return buf.view(np.uint32).reshape(-1, TOKENS)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from .textkit import utf8

    buf, offs = utf8(column)
    return np.ascontiguousarray(buf), offs


def _children(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path of child): a child is named by the tokens at two sampled positions; some nodes have a second one."""
    pick = mix(path + np.uint64(0x632BE59BD9B4E019))
    extra = np.flatnonzero((pick >> np.uint64(40)) < np.uint64(int(SECOND * (1 << 24))))
    rows, children = [np.arange(len(path)), extra], []
    for k, row in enumerate(rows):
        child = mix(path[row] + np.uint64(k + 1))
        for shift in (0, 6):
            place = (pick[row] >> np.uint64(12 * k + shift)) % np.uint64(TOKENS)
            child = mix(child * np.uint64(0x9E3779B97F4A7C15) + mix(tokens[row, place.astype(int)].astype(np.uint64) + (place << np.uint64(40))))
        children.append(child)
    return np.concatenate(rows), np.concatenate(children)


def _roots(reps: DataFrame, runs: int) -> DataFrame:
    places = np.random.Generator(np.random.PCG64(99)).permutation(TOKENS)
    places = np.concatenate([places] * (1 + runs // TOKENS))[:runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = _matrix(b.column("tokens"))[:, places].astype(np.uint64)
                path = mix(t + (np.arange(runs, dtype=np.uint64) << np.uint64(40)))
                rep = b.column("rep").take(pa.array(np.repeat(np.arange(b.num_rows), runs)))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64).ravel()), rep, rep], names=["path", "rep", "tag"])

    return reps.select("rep", "tokens").mapInArrow(run, "path long, rep long, tag long")


def _crowded(nodes: DataFrame) -> DataFrame:
    """Rows of nodes whose sets have several tags, with the node's number of sets and one of them, picked by the node's path.

    Sets with one tag are known to be in one group already, so a node of them has nothing more to tell.
    """
    sizes = nodes.groupBy("path").agg(F.count("*").alias("n"), F.min(F.col("rep").bitwiseXOR(F.col("path"))).alias("hub"), F.min("tag").alias("low"), F.max("tag").alias("high"))
    return nodes.join(sizes.filter("low < high").select("path", "n", F.col("hub").bitwiseXOR(F.col("path")).alias("hub")), "path")


def _split(large: DataFrame, reps: DataFrame) -> DataFrame:
    """Compares each set with its node's hub: (a, b, null) for likely links, (rep, tag, path) for children of the rest."""
    mine = reps.select("rep", F.col("tokens").alias("mine"))
    hubs = large.select("hub").distinct().join(reps.select(F.col("rep").alias("hub"), F.col("tokens").alias("theirs")), "hub")
    rows = large.select("path", "rep", "tag", "hub").join(mine, "rep").join(hubs, "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b.column("mine")), _matrix(b.column("theirs"))
            rep, hub = b.column("rep").to_numpy(), b.column("hub").to_numpy()
            alike = (x == y).mean(1)
            link = np.flatnonzero((alike >= NEAR_HUB) & (rep != hub))
            rest = np.flatnonzero(alike < CLOSE)
            tag = np.where(alike >= NEAR_HUB, hub, b.column("tag").to_numpy())
            row, child = _children(b.column("path").to_numpy().view(np.uint64)[rest], x[rest])
            a = pa.array(np.concatenate([hub[link], rep[rest][row]]))
            other = pa.array(np.concatenate([rep[link], tag[rest][row]]))
            path = pa.array(np.concatenate([np.zeros(len(link), np.int64), child.view(np.int64)]), mask=np.arange(len(link) + len(row)) < len(link))
            yield pa.RecordBatch.from_arrays([a, other, path], names=["a", "b", "path"])

    return rows.select("path", "rep", "tag", "hub", "mine", "theirs").mapInArrow(run, "a long, b long, path long")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node of its component under links a - b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def _small(small: DataFrame, reps: DataFrame) -> DataFrame:
    """Brute force within small nodes: links (a, b) that hold the likely pairs of each node together."""
    rows = small.select("path", "rep").join(reps.select("rep", "tokens"), "rep").repartition("path").sortWithinPartitions("path", "rep")

    def links(path: np.ndarray, rep: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.diff(path, prepend=~path[:1]))
        size = np.diff(np.append(start, len(path)))
        last = np.repeat(start + size, size)
        i = np.arange(len(path))
        n = last - i - 1
        a, b = np.repeat(i, n), ragged(i + 1, n)
        likely = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            likely[s] = (tokens[a[s]] == tokens[b[s]]).mean(1) >= LIKELY
        label = least_labels(len(path), a[likely], b[likely])
        moved = np.flatnonzero(label != i)
        return rep[label[moved]], rep[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("path").to_numpy(), b.column("rep").to_numpy(), _matrix(b.column("tokens"))))
            path, rep, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(path, path[-1]))  # the last node may go on in the next batch
            if whole:
                x, y = links(path[:whole], rep[:whole], tokens[:whole])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            held = [(path[whole:], rep[whole:], tokens[whole:])]
        if held:
            x, y = links(*held[0])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def candidate_groups(reps: DataFrame, runs: int) -> DataFrame:
    """(id, label) of all sets that are likely linked to another."""
    small, found = [], []
    nodes = _roots(reps, runs)
    while True:
        crowded = materialise(_crowded(nodes), "nodes")
        small.append(crowded.filter(F.col("n") <= SMALL).select("path", "rep"))
        large = crowded.filter(F.col("n") > SMALL)
        if not large.limit(1).count():
            break
        done = materialise(_split(large, reps), "split")
        found.append(done.filter("path IS NULL").select("a", "b"))
        nodes = done.filter("path IS NOT NULL").select("path", F.col("a").alias("rep"), F.col("b").alias("tag"))
    links = _small(functools.reduce(DataFrame.unionByName, small), reps)
    return components(functools.reduce(DataFrame.unionByName, found, links))


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i of left, j of right, i != j) of similarity NUM / DEN or more, as index arrays."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    all_ = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(all_, kind="stable")
    new = np.diff(all_[order], prepend=~all_[order[:1]]) != 0
    kind = np.empty(len(all_), np.int64)
    kind[order] = np.cumsum(new) - 1
    shared = np.bincount(kind)[kind] > 1
    used, kind = np.unique(kind[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(n, -1), np.full(n, -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    by = np.argsort(kind, kind="stable")
    kind, owner = kind[by], owner[by]
    step = 2048
    for lo in range(0, len(used), step):
        i, j = np.searchsorted(kind, (lo, lo + step))
        k, o = kind[i:j] - lo, owner[i:j]
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        on = place_l[o] >= 0
        x[place_l[o[on]], k[on]] = 1
        on = place_r[o] >= 0
        y[place_r[o[on]], k[on]] = 1
        common += x @ y.T
    total = sizes[left][:, None] + sizes[right][None, :] - common
    i, j = np.nonzero(DEN * common >= NUM * total)
    i, j = left[i], right[j]
    return i[i != j], j[i != j]


def _verified(members: DataFrame, words: int) -> DataFrame:
    """(rep, label, links, split) from (label, rep, copies, n, text): exact links within blocks of a group of candidates."""
    pieces = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), pieces).cast("int")
    rows = members.withColumns({"pieces": pieces, "mine": mine}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "copies", "pieces", "text")
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "rep")

    def group(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        _, i, j = key
        sets = [r[4] for r in rows]
        rep, copies, mine = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        if not len(left) or not len(right):
            return
        a, b = exact_links(sets, left, right)
        if i != j:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        links = np.bincount(a, copies[b], len(rows)).astype(np.int64)
        label = least_labels(len(rows), a, b)
        for k in np.flatnonzero(links):
            yield int(rep[k]), int(rep[label[k]]), int(links[k]), rows[k][3] > 1

    def out(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate(kinds)], names=["rep", "label", "links", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], []
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "i", "j")), strict=True))
            rest = list(zip(*(b.column(c).to_pylist() for c in ("rep", "copies", "mine", "pieces")), strict=True))
            for lo, hi, buf, offs in slices(b.column("text")):
                for key, r, s in zip(keys[lo:hi], rest[lo:hi], shingle_sets(buf, offs, words), strict=True):
                    if key != now:
                        if held:
                            done += group(now, held)
                        now, held = key, []
                    held.append((*r, s))
            if done:
                yield out(done)
                done = []
        if held:
            done += group(now, held)
        if done:
            yield out(done)

    return rows.mapInArrow(run, "rep long, label long, links long, split boolean")


def _classes(docs: DataFrame, words: int, recall: float) -> tuple[DataFrame, bool]:
    """Rows of ``jaccard_groups`` with their ``key`` and whether they ``lead`` their class; and whether an id has several sets.

    Sets are known by ``node``: the least doc_id that has them, or, where ids clash, a number in the order of that id and the key.
    """
    sets = materialise(_sets(docs, words), "sets")
    usable = sets.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    several = (F.min("key") != F.max("key")) | F.count("key").between(1, F.count("*") - 1)
    clash = bool(sets.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(several.alias("several")).filter("several").limit(1).count())
    reps = usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = reps.orderBy("rep", "key").withColumn("node", F.monotonically_increasing_id()) if clash else reps.withColumn("node", F.col("rep"))
    reps = materialise(reps, "reps")
    mine = usable.select(F.col("doc_id").alias("rep"), "key", "tokens").join(reps.select("rep", "key", "node"), ["rep", "key"])
    tokens = materialise(mine.groupBy(F.col("node").alias("rep")).agg(F.min("tokens").alias("tokens")), "tokens")
    groups = candidate_groups(tokens, runs_needed(recall))
    sized = groups.join(groups.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1"), "label")
    members = sized.join(reps.select(F.col("node").alias("rep"), "copies"), sized["id"] == F.col("rep")).select("label", "rep", "copies", "n")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").filter("rep IS NOT NULL AND text IS NOT NULL")
    if clash:
        texts = _keyed(texts, words).withColumnRenamed("__key", "key").join(reps.select("rep", "key", "node"), ["rep", "key"]).select(F.col("node").alias("rep"), "text")
    verified = materialise(_verified(members.join(texts, "rep").dropDuplicates(["rep"]), words), "verified")
    whole = verified.filter("NOT split").select("rep", "label", "links")
    split = verified.filter("split")
    if split.limit(1).count():
        labels = components(split.select(F.col("rep").alias("a"), F.col("label").alias("b")))
        counts = split.groupBy("rep").agg(F.sum("links").alias("links"))
        whole = whole.unionByName(counts.join(labels, counts["rep"] == labels["id"]).select("rep", "label", "links"))
    classes = reps.join(whole.withColumnRenamed("rep", "node"), "node", "left")
    if clash:
        classes = classes.join(reps.select(F.col("node").alias("label"), F.col("rep").alias("least")), "label", "left")
    else:
        classes = classes.withColumn("least", F.col("label"))
    alone = F.col("copies").isNull() | F.col("doc_id").isNull()
    return sets.select("doc_id", "key").join(classes, "key", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("least", "rep")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("copy_of"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        "key",
        F.when(alone, F.lit(True)).otherwise((F.coalesce("label", "node") == F.col("node")) & (F.col("doc_id") == F.col("rep"))).alias("leads"),
    ), clash


def jaccard_groups(docs: DataFrame, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, copy_of and n_links of every row of ``docs`` (doc_id, text).

    ``copy_of`` is the least doc_id with the same set of shingles, ``class_id`` the least one of the group that links of
    similarity 4/5 or more hold together, and ``n_links`` the number of other rows that are linked to this one, copies
    included. A text of fewer words than a shingle has one shingle of all its words; null and empty texts, and rows without
    doc_id, have no links and are their own class. Rows that repeat a doc_id are copies of each other when their texts are;
    otherwise each has the links of its own text.
    """
    return _classes(docs, words, recall)[0].drop("key", "leads")


def keep_one(docs: DataFrame, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without those that another document of their group stands for; the least doc_id stays, once.

    Of rows that share a doc_id one stays for each of its sets of shingles that nothing else stands for.
    """
    classes, clash = _classes(docs, words, recall)
    kept = classes.filter("leads AND doc_id IS NOT NULL")
    if clash:
        own, of, key = (unused(docs.columns, c) for c in ("__key", "__id", "__set"))
        kept = kept.select(F.col("doc_id").alias(of), F.col("key").alias(key)).distinct()
        named = _keyed(docs, words, own).join(kept, (F.col("doc_id") == F.col(of)) & F.col(own).eqNullSafe(F.col(key)), "left_semi").dropDuplicates(["doc_id", own]).drop(own)
    else:
        named = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id IS NULL"))
