"""Compression bands against a plain reading of the rule; the classifier on held-out documents."""

import os
import random

import numpy as np
import pytest
import zstandard

from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.quality_classifier import CLASSES, classify, features, train, scores
from orrery.llm.quality_rules import compression_bands, keep_compressible

BANDS = ((128, 0.35, 1.2), (256, 0.33, 1.0), (512, 0.30, 0.9), (1024, 0.27, 0.82), (2048, 0.25, 0.78), (4096, 0.22, 0.75), (16384, 0.20, 0.72))


def judged(t):
    ratio = lambda b: len(zstandard.ZstdCompressor(level=3, write_checksum=False).compress(b)) / len(b)
    band = lambda n: next((x[1:] for x in reversed(BANDS) if n >= x[0]), (0, 9e9))
    b = (t or "").encode()
    if not b:
        return True
    chunks = [b[i : i + 4096] for i in range(0, len(b), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) < 1024:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    out = sum(not band(len(c))[0] <= ratio(c) <= band(len(c))[1] for c in chunks)
    return band(len(b))[0] <= ratio(b) <= band(len(b))[1] and out <= 0.25 * len(chunks)


def test_bands(spark):
    rnd = random.Random(1)
    prose = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8))) for _ in range(n // 5))
    noise = lambda n: "".join(chr(rnd.randrange(33, 0x2FF)) for _ in range(n))
    texts = [None, "", " ", "x", "spam " * 999, "spam " * 400_000]
    for n in (100, 300, 700, 1500, 3000, 5000, 9000, 40_000):
        texts += [prose(n), noise(n), "line again. " * (n // 12), prose(n) + "zz " * (n // 3), prose(n) + noise(n)]
    rows = [(i if i else None, t, True) for i, t in enumerate(texts)] + [(5, texts[5], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep boolean")
    got = {(r.doc_id, r.keep) for r in compression_bands(df).collect()}
    assert got == {(i, judged(t)) for i, t, _ in rows} and {k for _, k in got} == {True, False}
    kept = keep_compressible(df)
    assert kept.schema == df.schema and sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if judged(r.text))
    assert compression_bands(df.limit(0)).count() == 0 and keep_compressible(df.limit(0)).count() == 0


def test_features():
    b = "Ab <x ABC".encode()
    parts, begins = features(np.frombuffer(b, np.uint8), np.array([0, 2, 2, 9]), 18)
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if len(w) + 2 >= n else []
    for part, begin, n in zip(parts[1:], begins[1:], (3, 4, 5)):
        want = [[g for w in t for g in grams(w, n)] for t in (["ab"], [], ["<x", "abc"])]
        assert [len(x) for x in want] == np.diff(begin).tolist()
        flat = [g for t in want for g in t]
        assert all((flat[i] == flat[j]) == (part[i] == part[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_held_out():
    rnd = random.Random(3)
    vocabulary = [["good", "river", "stone", "reading"], ["cheap", "click", "offer", "winner"]]
    text = lambda q, x: " ".join([rnd.choice(vocabulary[rnd.random() < (0.2 if q else 0.8)]) for _ in range(80)] + ["nastyword"] * (3 * x))
    data = [(text(q, x), q + 2 * x) for _ in range(250) for q in (0, 1) for x in (0, 1)]
    table, bias = train([t.encode() for t, _ in data[:800]], np.array([y for _, y in data[:800]]))
    raw = [t.encode() for t, _ in data[800:]]
    p = scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), table, bias)
    assert (p.argmax(axis=1) == np.array([y for _, y in data[800:]])).mean() > 0.95


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (3, "", 1), (None, "a b", 1), (1, "a b", 1), (4, "word " * 50_000, 1)], "doc_id long, text string, label int")
    schema = "doc_id long, quality int, toxic int"
    got = {(r.doc_id, r.p_quality, r.p_toxic, r.keep) for r in classify(docs, spark.createDataFrame([], schema)).collect()}
    assert got == {(i, 0.5, 0.5, True) for i in (1, 2, 3, None, 4)}
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, 0), (9, 1, 0)], schema)
    rows = classify(docs, labels).collect()
    assert len(rows) == 6 and len({(r.doc_id, r.p_quality) for r in rows}) == 5
    assert classify(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/labels.parquet"), reason="needs the driver's tables")
def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = classify(docs, labels.where("doc_id % 4 > 0"), sample=3000).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    assert ((rows.p_quality >= 0.5) == (rows.quality == 1)).mean() > 0.93
    clean = rows[(rows.quality == 1) & (rows.toxic == 0)]
    assert clean.keep.mean() > 0.97 and rows[rows.toxic == 1].p_toxic.mean() > 5 * clean.p_toxic.mean()


def grams(text):
    """The features of a text: its words, and all runs of 3 to 5 bytes of each word between marks."""
    words = bytes(c + 32 if 65 <= c <= 90 else c if c > 32 else 32 for c in text).split(b" ")
    words = [w for w in words if w]
    return [sorted(words), *(sorted(x[i : i + n] for w in words for x in (b"<" + w + b">",) for i in range(len(x) - n + 1)) for n in (3, 4, 5))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aBé <> \n", max_size=7), max_size=4))
def test_short_texts_have_features(texts):
    """Every split into few and short texts: as many features of each kind as there are grams, equal where these are equal."""
    raw = [t.encode() for t in texts]
    parts, begins = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 18)
    for kind, (part, begin) in enumerate(zip(parts, begins)):
        assert np.diff(begin).tolist() == [len(grams([*r])[kind]) for r in raw]
        buckets = {}
        for i, r in enumerate(raw):
            own = part[begin[i] : begin[i + 1]].tolist()
            assert len(set(own)) <= len(set(grams([*r])[kind]))
            assert buckets.setdefault(tuple(grams([*r])[kind]), sorted(own)) == sorted(own)


def test_one_letter(spark):
    """A document of one byte, taught and scored, alone in its batch and with others."""
    docs = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(classify(docs, labels).collect()) == 3 and len(classify(docs.where("doc_id = 3"), labels).collect()) == 1
    table, bias = train([b"a"], np.array([1]))
    assert scores(np.frombuffer(b"a", np.uint8), np.array([0, 1]), table, bias).shape == (1, CLASSES)


def plain_scores(text, vectors, bias, bits):
    """Softmax of the mean of the features' rows, one feature at a time."""
    parts, _ = features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), bits)
    rows = [vectors[b] for p in parts for b in p.tolist()]
    z = (sum(rows) / len(rows) if rows else 0) + bias
    return np.exp(z) / np.exp(z).sum()


def test_scores_and_steps_by_hand():
    """The whole operator on one core: each document's scores one feature at a time, and one training step against numerical gradients."""
    rnd, rng = random.Random(5), np.random.default_rng(5)
    raw = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(0, 20))).encode() for _ in range(40)]
    table, bias = rng.normal(size=(1 << 10, CLASSES)).astype(np.float32), rng.normal(size=CLASSES)
    got = scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), table, bias)
    assert np.allclose(got, [plain_scores(t, table.astype(float), bias, 10) for t in raw], atol=1e-5)
    y = np.array([rnd.randrange(CLASSES) for _ in raw])
    loss = lambda t, b: -sum(np.log(plain_scores(x, t.astype(float), b, 10)[k]) for x, k in zip(raw, y))
    few, many = (loss(*train(raw, y, bits=10, epochs=e, least_docs=1)) for e in (1, 20))
    assert many < 0.5 * few < 0.5 * loss(np.zeros((1 << 10, CLASSES)), np.zeros(CLASSES)) * 1.5
