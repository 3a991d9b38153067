"""The word model against a plain reading of the formula; its tables grow with the text."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.word_lm_scoring import TRIGRAMS, Table, build_words, discounts, trigram_block, trigrams_of, word_perplexity


def brute(corpus):
    """A function from text to log2 probability."""
    pad = ("<", "<")
    counts = {3: Counter()}
    for t in corpus:
        w = (*pad, *t.split())
        counts[3].update(w[i : i + 3] for i in range(len(w) - 2))
    for k in (2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: (0.0, *discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4)))) for k, c in counts.items()}
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        c = counts[k][g]
        return max(c - d[k][min(c, 3)], 0) / sum(seen) + sum(d[k][min(n, 3)] for n in seen) / sum(seen) * p(g[1:])

    return lambda t: sum(math.log2(p((*pad, *t.split())[i : i + 3])) for i in range(len(t.split())))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("range_bytes", [1 << 23, 1 << 10, 200])
def test_formula(spark, range_bytes):
    rnd = random.Random(3)
    word = lambda: rnd.choice("a a a b b c dd e f gé hh i".split())
    corpus = [" ".join(word() for _ in range(rnd.randrange(0, 60))) for _ in range(120)] + ["a b a b " * 300]
    other = ["new words only", "a b zz", " e \n f\thh ", "dd"]
    model, score = build_words(frame(spark, corpus), range_bytes=range_bytes), brute(corpus)
    for r in word_perplexity(frame(spark, corpus + other), model=model).collect():
        t = (corpus + other)[r.doc_id]
        assert r.n_words == len(t.split())
        assert r.perplexity is None if not t.split() else r.log2_probability == pytest.approx(score(t)) and r.perplexity == pytest.approx(2 ** (-score(t) / r.n_words))


@pytest.mark.parametrize("range_bytes", [1 << 23, 200])
def test_an_ngram_is_looked_for_in_one_table(spark, monkeypatch, range_bytes):
    """However many ranges the text has: a frequent word's contexts aren't sought in each of its parts, nor what repeats again."""
    rnd = random.Random(6)
    corpus = [" ".join(rnd.choice("a a a b c d e f".split()) for _ in range(60)) for _ in range(60)]
    model = build_words(frame(spark, corpus), range_bytes=range_bytes)
    assert range_bytes > 200 or max(model.ranges.parts) > 3
    keys, find = [], Table.find
    monkeypatch.setattr(Table, "find", lambda self, some: keys.append(len(some)) or find(self, some))
    text = " ".join(corpus).encode()
    model.score(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w = ("<", "<", *text.decode().split())
    distinct = [len({w[i + j : i + k] for i in range(len(w) - 2)}) for j, k in ((0, 3), (0, 2), (1, 3), (2, 3), (1, 2))]
    assert sum(keys) <= sum(distinct)


@pytest.mark.parametrize("range_bytes", [1 << 23, 200])
def test_all_ranges_are_searched_at_once(spark, monkeypatch, range_bytes):
    """As many searches with many tables as with one, of no n-gram twice."""
    from orrery.llm import word_lm_scoring

    rnd = random.Random(7)
    corpus = [" ".join(rnd.choice("a a a b c d e f".split()) for _ in range(60)) for _ in range(60)]
    model = build_words(frame(spark, corpus), range_bytes=range_bytes)
    assert range_bytes > 200 or len(model.files) > 50
    keys, found = [], word_lm_scoring.found
    monkeypatch.setattr(word_lm_scoring, "found", lambda tables, some, n: keys.append(len(some)) or found(tables, some, n))
    text = " ".join(corpus).encode()
    _, got = model.score(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w = ("<", "<", *text.decode().split())
    assert sorted(keys) == sorted(len({w[i + j : i + k] for i in range(len(w) - 2)}) for j, k in ((0, 3), (0, 2), (1, 3), (2, 3), (1, 2)))
    assert got[0] == pytest.approx(brute(corpus)(" ".join(corpus)))


def test_tables_grow_with_the_text(spark):
    rnd = random.Random(4)
    text = [" ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(100)) for _ in range(400)]
    size = lambda t: sum(n for (kind, _), (_, n, _) in build_words(frame(spark, t)).files.items() if kind == TRIGRAMS)
    distinct = lambda t: len({("<", "<", *x.split())[i : i + 3] for x in t for i in range(100)})
    assert size(text[:40]) == distinct(text[:40]) and size(text) == distinct(text) > 5 * distinct(text[:40])


def test_defined_results(spark):
    rows = [(None, "ab c"), (1, None), (2, ""), (3, "ab c"), (3, "ab c"), (4, "x " * 100_000)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, range string")
    got = {r.doc_id: r.perplexity for r in word_perplexity(df).collect()}
    assert got[1] is None and got[2] is None and got[None] == got[3] and got[4] < 1.1
    assert word_perplexity(df.limit(0)).count() == 0
    assert word_perplexity(df, model=build_words(df.where("doc_id = 2"))).where("doc_id = 3").first().perplexity == pytest.approx(1)


def test_registered_query_sees_words(spark, tmp_path):
    from orrery.llm.queries import op8_lm_scoring

    a, b = "one two three four five six seven eight", "eight three six one four seven two five"
    frame(spark, [a] * 20 + [b]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[0].n_words == 8 and got[0].perplexity * 1.5 < got[20].perplexity


def test_discounts():
    assert discounts(10, 4, 2, 1) == pytest.approx((1 - 2 * 10 / 18 * 4 / 10, 2 - 3 * 10 / 18 * 2 / 4, 3 - 4 * 10 / 18 * 1 / 2))
    assert discounts(0, 4, 2, 1) == (0.5, 1.0, 1.5) and discounts(1, 9, 9, 999) == (pytest.approx(1 / 19), pytest.approx(2 - 3 / 19), 0.0)


def test_held_out_text(spark):
    """Text of the corpus's kind is likelier than the same words in another order."""
    rnd = random.Random(5)
    then = {w: [rnd.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}

    def line():
        w = [rnd.choice("abcdefghij")]
        while len(w) < 60:
            w.append(rnd.choice(then[w[-1]]))
        return w

    model = build_words(frame(spark, [" ".join(line()) for _ in range(60)]))
    new = line()
    got = {r.doc_id: r.perplexity for r in word_perplexity(frame(spark, [" ".join(new), " ".join(rnd.sample(new, 60))]), model=model).collect()}
    assert got[0] * 1.5 < got[1]


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_table(data):
    """What is stored is found, with values small and large, and nothing else."""
    rng = np.random.default_rng(data.draw(st.integers(0, 1 << 30)))
    n, columns = data.draw(st.integers(1, 3000)), data.draw(st.sampled_from([1, 4, 5]))
    keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    values = [np.where(rng.random(len(keys)) < 0.1, rng.integers(0, data.draw(st.sampled_from([300, 1 << 20, 1 << 40])), len(keys)), rng.integers(0, 3, len(keys))) for _ in range(columns)]
    table = Table(b"".join(np.ascontiguousarray(x).tobytes() for x in Table.parts(keys, values)))
    some = rng.permutation(np.concatenate([keys, rng.integers(0, 1 << 64, 50, dtype=np.uint64)]))
    hit, got = table.find(some)
    assert set(some[hit].tolist()) == set(keys.tolist())
    want = dict(zip(keys.tolist(), zip(*(v.tolist() for v in values))))
    assert all(want[k] == tuple(v) for k, v in zip(some[hit].tolist(), got.tolist()))
    assert len(table.find(np.zeros(0, np.uint64))[0]) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 40)] * 3), min_size=1, max_size=300, unique=True), st.integers(1, 1 << 40))
def test_block(rows, most):
    rnd = random.Random(most)
    word = [rnd.randrange(1 << 48) for _ in range(41)]
    columns = [np.array([word[r[i]] for r in rows], np.uint64) for i in range(3)] + [np.array([rnd.randrange(1, most + 1) for _ in rows])]
    assert sorted(zip(*(x.tolist() for x in trigrams_of(trigram_block(*columns))))) == sorted(zip(*(x.tolist() for x in columns)))
