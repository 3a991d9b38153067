"""Supervised subword embeddings: word and character n-gram vectors, averaged over a document, into a softmax.

A document's features are its words and, of each word between the marks < and >, all runs of NGRAMS bytes, without ASCII case, hashed into
2**BITS buckets of DIM learned numbers. Classes are the pairs of the labels quality and toxic. Training is stochastic gradient descent
in numpy, one document a step, with a step size for each bucket that falls with its past gradients. Buckets of fewer than LEAST_DOCS training documents stay zero.

The training rows are at most SAMPLE labelled documents, of each of the four classes at most a quarter of that (1,500), those with the least hash
of their id: the one documented bound. The bias is then set to the classes' shares among all labels. All
documents are scored, each over its whole text, without a shuffle: embeddings times output weights are one table, which has a fixed size.

Defined results: a null, empty or blank text has no features and gets the scores of the bias alone; rows without an id are scored too;
label rows with a null, or for no document, teach nothing, and of repeated ones the least counts; without any label every score is 0.5 and
everything is kept; rows that repeat are scored alike; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, U, small, texts, word_hashes, words

NGRAMS, BITS, DIM, SAMPLE, EPOCHS, RATE = (3, 4, 5), 18, 16, 6000, 10, 2.0
#: A bucket learns if it stands in at least so many training documents; rarer ones would only be learned by heart.
LEAST_DOCS = 4
#: Least quality and greatest toxicity of what is kept.
QUALITY, TOXIC = 0.5, 0.3
CLASSES = 4  # quality + 2 * toxic
_SPREAD = U(0x9E3779B97F4A7C15)


def features(buf: np.ndarray, off: np.ndarray, bits: int = BITS, ngrams=NGRAMS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For words and each n: the buckets in text order, and where each text's begin."""
    buf = FOLD[buf]
    starts, ends, at = words(buf, off)
    n = ends - starts
    shift = U(64 - bits)
    out = [(word_hashes(buf, starts, ends) >> shift).astype(np.int32)]
    begin = [at]
    # each word between marks
    block = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(n + 2, out=block[1:])
    marked = np.full(block[-1], ord(">"), np.uint8)
    marked[block[:-1]] = ord("<")
    marked[np.arange(int(n.sum())) + np.repeat(1 + 2 * np.arange(len(starts)), n)] = buf[buf > 32]
    end = np.repeat(block[1:], n + 2)
    edge = block[at]
    x = np.zeros(len(marked), U)
    for k in range(max(ngrams)):
        x[: max(0, len(x) - k)] |= marked[k:].astype(U) << U(8 * k)
        if k + 1 in ngrams:
            i = np.flatnonzero(np.arange(k + 1, len(marked) + k + 1) <= end)
            y = x[i]
            y ^= y >> U(15)
            y *= U(int(_SPREAD) * (2 * k + 3) % (1 << 64))
            out.append((y >> shift).astype(np.int32))
            begin.append(np.searchsorted(i, edge))
    return out, begin


def counted(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and the share of its features that each has."""
    buf = np.frombuffer(text, np.uint8)
    parts, _ = features(buf, np.array([0, len(buf)]), bits)
    u, c = np.unique(np.concatenate(parts), return_counts=True)
    return u, (c / max(1, c.sum())).astype(np.float32)


def train(raw: list[bytes], labels: np.ndarray, bits: int = BITS, **options) -> tuple[np.ndarray, np.ndarray]:
    """Score table (2**bits, CLASSES) and bias, from texts."""
    return train_counted([counted(t, bits) for t in raw], labels, bits, **options)


def train_counted(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, least_docs: int = LEAST_DOCS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The same, from buckets and shares."""
    rng = np.random.default_rng(seed)
    known = np.zeros(1 << bits, np.int32)
    for u, _ in docs:
        known[u] += 1
    # only buckets that learn are held while training, side by side
    place = np.cumsum(known >= least_docs) - 1
    docs = [(place[u[k]], f[k]) for u, f in docs for k in (known[u] >= least_docs,)]
    size = int(place[-1]) + 1
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    weights = rng.normal(0, 1 / np.sqrt(dim), (dim, CLASSES)).astype(np.float32)
    bias, past = np.zeros(CLASSES, np.float32), np.zeros(size, np.float32)
    past_w, past_b = np.full((dim, CLASSES), 1e-6, np.float32), np.full(CLASSES, 1e-6, np.float32)
    if len(labels):
        share = np.bincount(labels, minlength=CLASSES) + 1
        bias[:] = np.log(share / share.sum())
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            u, f = docs[i]
            v = vectors[u]
            hidden = f @ v
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            # every feature's gradient is its share times back
            seen = past[u] + f * f * float(back @ back)
            past[u] = seen
            vectors[u] = v - (step * f / np.sqrt(seen + 1e-10))[:, None] * back
            g = np.outer(hidden, p)
            past_w += g * g
            past_b += p * p
            weights -= 0.1 * step * g / np.sqrt(past_w)
            bias -= 0.1 * step * p / np.sqrt(past_b)
    table = np.zeros((1 << bits, CLASSES), np.float32)
    table[known >= least_docs] = vectors @ weights
    return table, bias


def scores(buf: np.ndarray, off: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Softmax of the mean over each text's features."""
    bits = int(len(table)).bit_length() - 1
    total, count = np.zeros((len(off) - 1, CLASSES)), np.zeros(len(off) - 1)
    for part, begin in zip(*features(buf, off, bits)):
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            total[some] += np.add.reduceat(table[part], begin[some], axis=0, dtype=np.float32)
            count += np.diff(begin)
    z = total / np.maximum(count, 1)[:, None] + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, **options) -> tuple[np.ndarray, np.ndarray]:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("label")).where(f"doc_id is not null and label between 0 and {CLASSES - 1}")
    texts_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"))
    all_ = dict(rows.groupBy("label").count().collect())
    if not all_:
        return np.zeros((1 << BITS, CLASSES), np.float32), np.zeros(CLASSES, np.float32)
    # a top-n by hash for each class: no class is sorted as a whole
    chosen = reduce(DataFrame.unionByName, (rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // CLASSES) for c in all_))
    pairs = texts_.join(small(chosen, sample, 12), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def featured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            u, c = zip(*(counted((t or "").encode(), options.get("bits", BITS)) for t in b.column("text").to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(u, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.float32()))], names=["doc_id", "label", "buckets", "shares"])

    # texts stay with the executors: the driver gets the distinct buckets, which are at most 2**bits a document
    rows = pairs.mapInArrow(featured, "doc_id long, label int, buckets array<int>, shares array<float>").toArrow().sort_by("doc_id").combine_chunks()
    taught = rows.column("label").to_numpy().astype(np.int64)
    table, bias = train_counted([(u.values.to_numpy(), c.values.to_numpy()) for u, c in zip(rows.column("buckets"), rows.column("shares"))], taught, **options)
    here, there = np.bincount(taught, minlength=CLASSES), np.array([all_.get(c, 0) for c in range(CLASSES)])
    some = (here > 0) & (there > 0)
    bias[some] += np.log(there[some] / there.sum()) - np.log(here[some] / here.sum())
    return table, bias


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, **options) -> DataFrame:
    """doc_id, p_quality, p_toxic, keep: one row for each row of docs; keep is for a quality of at least QUALITY and a toxicity of at most TOXIC."""
    table, bias = fit(docs, labels, id_col, text_col, sample, **options)
    learned = bool(np.any(bias))  # not so without labels
    model = docs.sparkSession.sparkContext.broadcast((table, bias))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for rows, buf, off in texts(it):
            p = scores(buf, off, table, bias) if learned else np.full((rows.num_rows, CLASSES), 0.25)
            quality, toxic = p[:, 1] + p[:, 3], p[:, 2] + p[:, 3]
            keep = (quality >= QUALITY) & (toxic <= TOXIC) if learned else np.ones(rows.num_rows, bool)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(quality), pa.array(toxic), pa.array(keep)], names=["doc_id", "p_quality", "p_toxic", "keep"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, p_quality double, p_toxic double, keep boolean")
