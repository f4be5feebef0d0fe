"""Decontamination, whitening and the prefix trie against brute force, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import decontaminate, prefix_trie, queries, whitening


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def against_sql(name, spark, sf, rows):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = db.sql(queries.ORACLES[name]).to_arrow_table().to_pylist()
    key = lambda r: sorted((k, repr(v)) for k, v in r.items())
    assert sorted(map(key, rows)) == sorted(map(key, want))


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def brute_hits(texts, items, window):
    asked = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            asked[tuple(w[k : k + window])].add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(a) for a in asked}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in asked:
                    hit |= set(range(k, k + n))
                    found |= asked[tuple(w[k : k + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def awkward_texts():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(["the", "Of", "and", "river", "é漢", "x9", "stone"]) for _ in range(n))
    bench = [prose(30), prose(12), "one two", "STONE", None, "", " -- ", prose(10), "une, deux; trois!"]
    docs = [None, "", "...", "stone", "a stone's throw", bench[0], "pre " + bench[0].replace("river", "RIVER") + " post", bench[0] + " " + bench[1], bench[0][5:60], "x " * 50 + "one-TWO" + " y" * 70, prose(3000) + " " + bench[7] + " " + prose(500), "Une deux  trois", "éa one two\x00three", bench[1] * 40]
    docs += [prose(r.randrange(40)) for _ in range(40)] + [bench[1]] * 5
    return docs, [*enumerate(bench), (7, bench[7]), (20, bench[1]), (None, "the")]


@pytest.mark.parametrize(("window", "shard_words", "block_pairs"), [(10, 1 << 19, 1 << 17), (10, 64, 7), (3, 200, 50)])
def test_contamination(spark, window, shard_words, block_pairs):
    texts, items = awkward_texts()
    docs = spark.createDataFrame([(None if k == 4 else k, t, "x", [k]) for k, t in enumerate(texts)], "doc_id long, text string, row string, spans array<int>").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.contamination(docs, bench, window, shard_words, block_pairs))
    want = brute_hits(texts, [i for i in items if i[0] is not None], window)
    assert len(got) == len(texts)
    for r in got:
        k = 4 if r["doc_id"] is None else r["doc_id"]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want[k], (k, r)


def test_contamination_query_against_sql(spark, sf):
    against_sql("op11_decontaminate", spark, sf, rows_of(queries.op11_decontaminate(spark, sf)))


def test_removal_cuts_the_passages_alone(spark):
    texts, items = awkward_texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(5, texts[5], "again")], "doc_id long, text string, row string")
    out = decontaminate.remove_passages(docs, spark.createDataFrame(items, "item_id long, text string"), shard_words=100)
    assert out.columns == docs.columns and out.count() == len(texts) + 1
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    clean = [k for k, h in enumerate(brute_hits(texts, [i for i in items if i[0] is not None], 10)) if not h[4]]
    assert clean and all(got[k] == texts[k] for k in clean)
    assert got[5] == "" and got[6] == "pre  post" and got[4] == "a 's throw" and got[12] == "éa \x00three" and got[9].split() == ["x"] * 50 + ["y"] * 70


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "the")], "doc_id long, text string"), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert not rows_of(decontaminate.contamination(docs.limit(0), bench))
    (row,) = rows_of(decontaminate.contamination(docs, bench.limit(0)))
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (1, 0, 0, False)


@pytest.mark.parametrize("seed", range(6))
def test_index_of_a_shard(seed):
    r = np.random.default_rng(seed)
    text = r.integers(0 if seed else 1, 4 + seed, 700) if seed != 2 else np.tile([1, 2, 1], 200)
    text[-1] = 0
    ends = np.flatnonzero(text == 0)
    key = [tuple((0, i) if text[i] == 0 else (1, int(text[i])) for i in range(k, int(ends[np.searchsorted(ends, k)]) + 1)) for k in range(len(text))]
    assert decontaminate.suffix_order(text).tolist() == sorted(range(len(text)), key=key.__getitem__)
    symbols = int(text.max()) + 1
    index = decontaminate.FmIndex(*decontaminate.FmIndex.build(text, symbols).values())
    phrases = np.array([[-1] * (3 - n) + r.integers(1, symbols, n).tolist() for n in (1, 2, 3) for _ in range(20)])
    low, high = index.intervals(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        p = p[p > 0]
        want = [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# whitening

VECTORS = "vec_id long, embedding array<double>, label int, deviation string, whitened string, x int"


def test_whitening_against_fractions(spark):
    r = random.Random(3)
    vectors = [[r.gauss(0, 1) * s + 1000 for s in (5, 3, 2, 1, 0.5, 0.1)] for _ in range(60)]
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] * 6, [], [1.0, 2.0]]
    rows = vectors + vectors[:20] + bad + [vectors[7]] * 30
    df = spark.createDataFrame([(k, v, 1, "d", "w", 5) for k, v in enumerate(rows)], VECTORS).repartition(4)
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    v = [[Fraction(sum(a[i] * a[j] for a in x), n) - Fraction(s[i] * s[j], n * n) for j in range(6)] for i in range(6)]
    model = whitening.fit(df)
    assert (model.n, model.sums) == (n, s)
    assert all(Fraction(model.scatter[i, j], n * n) == v[i][j] for i in range(6) for j in range(6))
    values, components = np.linalg.eigh(np.array(v, float))
    out = collections.defaultdict(dict)
    for row in rows_of(whitening.whitened_rows(df)):
        out[row["vec_id"]][row["component"]] = row
    assert sorted(out) == [k for k, w in enumerate(rows) if w is not None and len(w) == 6 and all(c is not None and np.isfinite(c) for c in w)]
    sign = {}
    for k, found in out.items():
        y = [int(np.floor(256 * c)) for c in rows[k]]
        assert sorted(found) == [1, 2, 3, 4]
        for c, row in found.items():
            assert row["n"] == n and row["deviation"] == sum((n * a - b) ** 2 for a, b in zip(y, s, strict=True))
            want = float(np.dot([float(Fraction(a) - Fraction(b, n)) for a, b in zip(y, s, strict=True)], components[:, -c]) / np.sqrt(values[-c]))
            sign.setdefault(c, np.sign(want * row["whitened"]))
            assert row["whitened"] == pytest.approx(want * sign[c], abs=1e-6)
            assert row["explained"] == pytest.approx(values[-c] / values.sum(), rel=1e-9) and row["identity_error"] < 1e-9


def test_scatter_of_any_size_is_exact():
    r = random.Random(9)
    for high in (10, 1 << 19, 1 << 35, (1 << 63) - 1):
        x = np.array([[r.randrange(-high, high) for _ in range(3)] for _ in range(50)], np.int64)
        got = whitening._Scatter(x[0])
        got.add(x[:20])
        got.add(x[20:])
        whole = x.astype(object)
        assert (got.products == whole.T.dot(whole)).all() and (got.sums == whole.sum(axis=0)).all() and got.n == 50


def test_whitening_of_far_entries_and_none(spark):
    far = spark.createDataFrame([(k, [k * 1e300, float(k)], 1, "d", "w", 5) for k in range(4)] + [(9, [1e8 * 3, -1e8], 1, "d", "w", 5)], VECTORS)
    out = rows_of(whitening.whitened_rows(far))
    assert {r["vec_id"] for r in out} == {0, 1, 2, 3, 9} and any(r["deviation"] is None for r in out)
    assert not rows_of(whitening.whitened_rows(far.limit(0)))
    assert not rows_of(whitening.whitened_rows(far.filter("vec_id = 1").unionAll(far.filter("vec_id = 1"))))
    kept = whitening.whiten(far, whitening.fit(far), keep=("vec_id", "deviation", "whitened", "x"))
    assert kept.columns == ["vec_id", "deviation", "whitened", "x", "deviation_", "whitened_"] and kept.count() == 5


def test_whitening_query_whitens(spark, sf):
    out = queries.op12_whitening(spark, sf).toPandas()
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-9 and np.abs(w.mean(axis=0)).max() < 1e-9  # all vectors there differ


# prefix trie


def brute_trie(rows, borrow):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, t in turns.items():
        if borrow:
            h = zlib.crc32(str(c).encode()) % borrow[1]
            base = c - int(np.fmod(c, borrow[0]))
            t = turns.get(base, [])[:h] + t[h:]
        whole[c] = tuple(t)
    members = collections.defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in under)
        ends = ",".join(str(c) for c in sorted(cs) if whole[c] == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(o) == len(p) + 1 for o in under), sum(map(leaf, under)), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()), key=repr)


def talks():
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["hi", "é", "", "ok then", "a b"])) for c in range(-12, 40) for t in range(r.randrange(6)) if r.random() < 0.9]
    rows += [(50, t, "user", f"long {t % 3}") for t in range(70)] + [(c, t, "user", "copy") for c in range(60, 85) for t in range(4)]
    rows += [(90, None, "user", "first"), (90, 1, None, "b"), (90, 1, "a", None), (90, 1, "a", None), (None, 0, "user", "nobody"), (96, 0, "user", "x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("borrow", "bound", "together"), [((5, 9), 1024, 1 << 14), ((5, 9), 4, 10), (None, 16, 1), ((7, 3), 1, 1 << 14)])
def test_prefix_trie(spark, borrow, bound, together, monkeypatch):
    rows = talks()
    if bound < 16:
        monkeypatch.setattr(prefix_trie, "isqrt", lambda _: 1)  # so that most of the trie is heavy
        monkeypatch.setattr(prefix_trie, "MOST_SENT", 3)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, base string").repartition(3)
    assert trie_rows(prefix_trie.prefix_trie(df, borrow, bound, together)) == brute_trie(rows, borrow)


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert not rows_of(prefix_trie.prefix_trie(df, (5, 9)))


def test_prefix_trie_query_against_sql(spark, sf):
    against_sql("op13_prefix_trie", spark, sf, rows_of(queries.op13_prefix_trie(spark, sf)))


def test_level_order():
    level, parent, label = np.array([0, 1, 0, 1, 2, 1]), np.array([-1, 0, -1, 0, 3, 2]), np.array([5, 9, 4, 7, 1, 1])
    nodes, bits, sizes = prefix_trie.Louds.order(level, parent, label)
    assert nodes.tolist() == [2, 0, 5, 3, 1, 4] and sizes.tolist() == [2, 3, 1]
    assert bits.astype(int).tolist() == [1, 1, 0, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0]
    louds = prefix_trie.Louds(bits, sizes)
    assert louds.parent.tolist() == [-1, -1, 0, 1, 1, 3] and louds.degree.tolist() == [1, 2, 0, 1, 0, 0]
    weight = np.ones(6, np.int64)
    louds.roll_up(weight)
    assert weight.tolist() == [2, 4, 1, 2, 1, 1]


def test_names_are_whole_bytes():
    names = prefix_trie._names(np.array([0, 1]), np.array([2, 0]))
    assert names.type == pa.binary(16) and len({n.as_py() for n in names}) == 2
