"""The three models' scores of whole texts against plain Python, one text, line and word at a time."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from skeinwork.llm import line_quality, quality_classifier, textkit, toxicity

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
ODD = ["", None, " \n\n ", "!!!", "one", "Grüße, GRÜSSE und\tTab", "a-b_c " * 300, "line one\n\n# $ %\nLINE TWO!\nline one\n", "é" * 70 + " x"]


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def texts(tables):
    found = [r["text"] for r in tables[0].orderBy("doc_id").collect()]
    return [*found, *ODD]


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def small(data):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def hashed(data):
    return int(textkit.Hasher(np.frombuffer(data, np.uint8)).spans(np.array([0]), np.array([len(data)]))[0])


def plain_toxicity(model, text):
    """(score, spans) by sums over both states, forwards and backwards."""
    word, head = (dict(zip(w.keys.tolist(), w.values.tolist(), strict=True)) for w in (model.word, model.head))
    found = list(WORD.finditer(text or ""))
    e = [max(-30.0, min(30.0, word.get(hashed(small(m[0].encode())), 0.0) + head.get(hashed(small(m[0].encode()[: toxicity.HEAD_BYTES])), 0.0) + model.bias)) for m in found]
    move, n = np.exp(model.chain.trans), len(e)
    ahead, behind = np.ones((n, 2)), np.ones((n, 2))
    for t in range(n):
        ahead[t] = np.array([1.0, math.exp(model.chain.start)]) if t == 0 else ahead[t - 1] @ move
        ahead[t] *= [1.0, math.exp(e[t])]
        ahead[t] /= ahead[t].sum()
    for t in range(n - 2, -1, -1):
        behind[t] = move @ (behind[t + 1] * [1.0, math.exp(e[t + 1])])
        behind[t] /= behind[t].sum()
    odds = [math.log(a[1] * b[1]) - math.log(a[0] * b[0]) for a, b in zip(ahead, behind, strict=True)]
    total, top = sum(sigmoid(o) for o in odds if o > 0), max(odds, default=-30.0)
    score = sigmoid(float(np.dot([math.log1p(total), max(-30.0, min(30.0, top)) / 10, 1.0], model.document)))
    return score, [(m.start(), m.end()) for m, o in zip(found, odds, strict=True) if o > 1e-6], {(m.start(), m.end()) for m, o in zip(found, odds, strict=True) if o > -1e-6}


def test_scores_and_spans_of_toxicity(spark, tables, texts):
    model = toxicity.train(*tables)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in toxicity.tag(df, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        score, surely, maybe = plain_toxicity(model, t)
        spans = [(s["start"], s["end"]) for s in got[i]["spans"]]
        assert got[i]["score"] == pytest.approx(score, abs=1e-5), i
        assert set(surely) <= set(spans) <= maybe and spans == sorted(spans), i
    assert any(r["spans"] for r in got.values())


def plain_states(model, features):
    """The likeliest states of lines by the best way into each."""
    best, back = [], []
    for t, e in enumerate(features @ model.weights):
        if t == 0:
            best.append([0.0, model.chain.start + e])
            continue
        ways = [[best[-1][i] + model.chain.trans[i][j] + (e if j else 0.0) for i in (0, 1)] for j in (0, 1)]
        back.append([int(w[1] > w[0]) for w in ways])
        best.append([max(w) for w in ways])
    if not best:
        return []
    out = [int(best[-1][1] > best[-1][0])]
    for b in reversed(back):
        out.append(b[out[-1]])
    return out[::-1]


def test_kept_texts_of_line_quality(spark, tables, texts):
    model = line_quality.train(*tables)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in line_quality.line_quality(df, model, with_lines=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        m = line_quality.measure(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in re.split(r"\n", t or "")]
        words = [n for n in words if n]
        states = plain_states(model, m.features)
        assert got[i]["content_lines"] == [bool(s) for s in states] and len(states) == len(words), i
        share = sum(n for n, s in zip(words, states, strict=True) if s) / max(1, sum(words))
        failed = sum(words) < 50 or 100 * got[i]["n_repeat_words"] > 50 * sum(words)
        assert got[i]["content_share"] == pytest.approx(share) and got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and share >= line_quality.CONTENT_SHARE)
    assert len({r["kept"] for r in got.values()}) == 2


def plain_features(text):
    raw = (text or "").encode()
    found = {((((raw[k] << 16) | (raw[k + 1] << 8) | raw[k + 2]) * 2654435761) % 2**32) >> (32 - quality_classifier.GRAM_BITS) for k in range(len(raw) - 2)}
    before, last = 0, None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        share = lambda test: sum(map(test, w)) / len(w)  # noqa: B023, E731
        upper, digit, markup = share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b"#*$%&|<>{}[]=_~^\\@")
        shape = sum(len(w) >= n for n in (2, 3, 4, 6, 9, 15, 30))
        for bit in (upper > 0, upper > 0.5, digit > 0, markup > 0, markup > 0.5, w[-1] == 33, w == last):
            shape = shape * 2 + bit
        code = ((shape * 2051 + before) * 0x9E3779B97F4A7C15) % 2**64
        found.add((code >> (64 - quality_classifier.SHAPE_BITS)) + (1 << quality_classifier.GRAM_BITS))
        before, last = shape + 1, w
    return sorted(found)


def test_features_of_quality(texts):
    some = texts[::4] + ODD
    assert [x.tolist() for x in quality_classifier.indicators(pa.array(some, pa.string()))] == [plain_features(t) for t in some]
