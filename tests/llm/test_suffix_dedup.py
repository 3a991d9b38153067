"""Repeated passages against brute force over all windows."""

import random

import pytest

from orrery.llm import suffix_dedup
from orrery.llm.suffix_dedup import cut_repeats, repeated_passages


def brute(rows, least):
    """Words of each document that lie in a window which stands earlier."""
    seen, out = set(), {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t}):
        w = text.split()
        for i in range(len(w) - least + 1):
            window = tuple(w[i : i + least])
            if window in seen:
                out.setdefault(doc, set()).update(range(i, i + least))
            seen.add(window)
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    pieces = [[word() for _ in range(rnd.randrange(8, 60))] for _ in range(12)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rnd.randrange(1, 8)):
            w += rnd.choice(pieces) if rnd.random() < 0.6 else [word() for _ in range(rnd.randrange(1, 30))]
            if rnd.random() < 0.1:
                w += [rnd.choice("ab")] * rnd.randrange(1, 40)
        rows.append((d, rnd.choice([" ", "\n", "  "]).join(w)))
    return rows + [(rnd.randrange(100, 200), t) for _, t in rows[:5]]


@pytest.mark.parametrize("seed, hot", [(1, 20_000), (2, 20_000), (3, 3)])
def test_all_repeats(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeated_passages(df, least=20, prefix=6, hot=hot)) == brute(rows, 20)


def test_defined_results(spark):
    long = " ".join(f"a{i}" for i in range(30))
    rows = [(None, long), (1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, long + " end"), (6, "x " * 200)]
    df = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, th string, n_chars long")
    got = found(repeated_passages(df, least=20, prefix=6))
    assert got == {5: set(range(30)), 6: set(range(1, 200))}
    left = {(r.doc_id, r.text, r.th, r.n_chars) for r in cut_repeats(df, least=20, prefix=6).collect()}
    assert left == {(None, long, "k", 0), (1, None, "k", 0), (2, "", "k", 0), (3, " \n", "k", 0), (4, long, "k", 0), (5, "end", "k", 3), (6, "x ", "k", 2)}
    assert repeated_passages(df.limit(0)).count() == 0 and cut_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 1, 2, 5, 10, 100])
def test_any_group_size(spark, hot):
    """The same repeats, however many suffixes may share a prefix, with documents of one id and of several texts among them."""
    rows = corpus(10 + hot)
    rows += [(7, t) for _, t in corpus(99)[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for (d, _), own in by_text(rows, 20).items():
        want.setdefault(d, set()).update(own)
    assert found(repeated_passages(df, least=20, prefix=6, hot=hot)) == want


def by_text(rows, least):
    """As brute(), with the texts of one id apart. They come by hash, which is taken here from Spark's own results: whichever is first, the union over both orders holds."""
    seen, out = set(), {}
    texts = sorted({(d, th, t) for d, th, t in hashed(rows)})
    for doc, th, text in texts:
        w = text.split()
        for i in range(len(w) - least + 1):
            window = tuple(w[i : i + least])
            if window in seen:
                out.setdefault((doc, th), set()).update(range(i, i + least))
            seen.add(window)
    return out


def hashed(rows):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    df = SparkSession.getActiveSession().createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in df.select("doc_id", F.xxhash64("text"), "text").collect()]


def test_long_copies_are_cut_into_short_suffixes(spark, monkeypatch):
    """Copies of a long text: suffixes are a small part of it, and everything is found; at every anchor, at some and at hardly any."""
    rnd = random.Random(6)
    long = " ".join(f"w{rnd.randrange(5000)}" for _ in range(20_000))
    rows = [(i, f"start{i} {long} end{i}") for i in range(4)] + [(9, " ".join(long.split()[5000:9000]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for every in (1, 32, 10**9):
        monkeypatch.setattr(suffix_dedup, "BREAK", every)
        assert found(repeated_passages(df)) == {**{i: set(range(1, 20_001)) for i in (1, 2, 3)}, 9: set(range(4000))}


def test_hot_passage(spark):
    """One passage in thousands of documents, and one that only some of these continue."""
    passage, tail = " ".join(f"p{i}" for i in range(60)), " ".join(f"t{i}" for i in range(80))
    rows = [(i, f"a{i} {passage} " + (f"{tail} z{i}" if i % 500 == 3 else f"b{i} c{i}")) for i in range(6000)]
    got = found(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot=1000))
    assert got == {i: set(range(1, 141 if i % 500 == 3 and i > 3 else 61)) for i in range(1, 6000)}


@pytest.mark.parametrize("hot", [10**9, 3])
def test_texts_are_read_twice(spark, hot):
    """For anchors and for suffixes; hot passages need no pass, and so no exchange of texts, of their own."""
    rows = corpus(20)
    rows += rows[:5]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(repeated_passages(df.mapInArrow(counted, df.schema), least=20, prefix=6, hot=hot)) == brute(rows, 20)
    assert read.value == 2 * len(rows)
