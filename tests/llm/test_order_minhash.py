"""Near-duplicates against alignment of all pairs."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm.common import Scratch, hashed_words
from orrery.llm.order_minhash import components, distance_within, drop_near_duplicates, near_duplicates, parts, roots, similar, sketch


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_distance(x, y, most):
    d = levenshtein(x, y)
    assert distance_within(x, y, most) == (d if d <= most else None)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(500)}"
    rows, base = [], [[word() for _ in range(rnd.choice([1, 2, 3, 8, 40, 150, 400]))] for _ in range(40)]
    for d in range(200):
        w = list(rnd.choice(base))
        for _ in range(int(len(w) * rnd.choice([0, 0.02, 0.05, 0.1]))):
            i = rnd.randrange(len(w))
            rnd.choice([lambda: w.insert(i, word()), lambda: w.pop(i), lambda: w.__setitem__(i, word())])()
        rows.append((d, " ".join(w)))
    return rows


def brute(rows, similarity=0.8):
    w = {d: hashed_words(t, fold=True) for d, t in rows}
    root = {d: d for d in w}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(sorted(w), 2):
        if similar(w[a], w[b], similarity) is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {(d, top(d)) for d in w if top(d) != d}


def test_groups(spark):
    rows = corpus(1)
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.95 * len(want) and not {d for d, _ in got} - {d for d, _ in want}


def test_defined_results(spark):
    long = " ".join(f"a{i}" for i in range(5000))
    rows = [(None, "x y"), (1, None), (2, ""), (3, " "), (4, "x  Y"), (5, "x y"), (5, "x y"), (6, long), (7, long + " b")]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, keys string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == {(5, 4), (7, 6)}
    assert sorted((r.doc_id or 0, r.text or "", r["keys"]) for r in drop_near_duplicates(df).collect()) == sorted((d or 0, t or "", "k") for d, t in rows if d not in (5, 7))
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0


def test_similar():
    x = np.arange(100, dtype=np.uint64)
    assert similar(x, x, 0.8) == 1 and similar(x, x[20:], 0.8) == 0.8 and similar(x, x[21:], 0.8) is None


def test_every_pair_of_a_bucket_counts(spark):
    """Copies of an absent base, most of them too far from their bucket's least: as if all pairs of all buckets were aligned."""
    rnd = random.Random(7)
    base, rows = [f"b{i}" for i in range(80)], []
    for d in range(150):
        w = list(base)
        for i in rnd.sample(range(80), rnd.randrange(9, 12)):
            w[i] = f"x{rnd.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    w = {d: hashed_words(t, fold=True) for d, t in rows}
    keys = {d: set(sketch(x).tolist()) for d, x in w.items()}
    root = {d: d for d in w}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(w, 2):
        if keys[a] & keys[b] and similar(w[a], w[b], 0.8) is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d, top(d)) for d in w if top(d) != d} and len(got) > 50


def test_short_pairs_share_a_part():
    rnd = random.Random(8)
    for n in range(1, 33):
        for _ in range(100):
            x = [rnd.randrange(6) for _ in range(n)]
            y = list(x)
            for _ in range(int(n * 0.2 + 1e-9)):
                i = rnd.randrange(len(y) or 1)
                rnd.choice([lambda: y.insert(i, rnd.randrange(6)), lambda: y.pop(i), lambda: y.__setitem__(i, rnd.randrange(6))])()
            if x == y or len(y) > 32 or similar(np.array(x), np.array(y), 0.8) is None:
                continue
            a, b = ({(s, *w[i:j]) for i, j, s in zip(*(p.tolist() for p in parts(len(w), 0.8)))} for w in (x, y))
            assert a & b


def test_recall_of_short_pairs(spark):
    """Every pair of similarity 0.8 to 0.86, of 5 to 32 words, without a sketch in common or with one."""
    rnd, rows = random.Random(9), []
    for d in range(0, 840, 2):
        w = [f"{d}-{i}" for i in range(5 + d // 2 % 28)]
        rows.append((d, " ".join(w)))
        for i in rnd.sample(range(len(w)), int(len(w) * 0.2 + 1e-9)):
            w[i] = f"{d}+{i}"
        rows.append((d + 1, " ".join(w)))
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d + 1, d) for d in range(0, 840, 2)}


def plain_groups(pairs):
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {(v, r) for v, r in root.items() if v != r}


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(-5, 200), (7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = plain_groups(pairs)
    assert {tuple(r) for r in components(edges, Scratch(spark)).collect()} == {tuple(r) for r in components(edges, Scratch(spark), 0).collect()} == want
    v, r = roots(*np.array(pairs).T)
    assert {(x, y) for x, y in zip(v.tolist(), r.tolist()) if x != y} == want
    assert components(edges.limit(0), Scratch(spark)).count() == components(edges.limit(0), Scratch(spark), 0).count() == 0


def test_independent_alignment(spark):
    """Groups against the plain edit distance of the words themselves, over all pairs, for texts of every length to 60 words."""
    rnd, rows = random.Random(11), []
    for d in range(0, 180, 3):
        w = [f"{rnd.choice('ab')}{rnd.randrange(30)}" for _ in range(1 + d // 3)]
        rows.append((d, w))
        for e in (1, 2):
            v = list(w)
            for _ in range(int(len(w) * rnd.choice([0, 0.1, 0.15, 0.25]))):
                i = rnd.randrange(len(v))
                rnd.choice([lambda: v.insert(i, f"z{rnd.randrange(99)}"), lambda: v.pop(i), lambda: v.__setitem__(i, f"z{rnd.randrange(99)}")])()
            rows.append((d + e, v))
    near = [(i, j) for (i, x), (j, y) in itertools.combinations(rows, 2) if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) > 0 and levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9]
    df = spark.createDataFrame([(d, " ".join(w).upper() if d % 2 else "\n".join(w)) for d, w in rows], "doc_id long, text string")
    got, want = {tuple(r) for r in near_duplicates(df).collect()}, plain_groups(near)
    assert not {d for d, _ in got} - {d for d, _ in want} and len(got & want) >= 0.97 * len(want) and len(want) > 40


def test_bucket_of_unlike_documents(spark):
    """Thousands of texts share a part and nothing else: none is taken for another's copy, and the copies among them are found, in however many parts they meet."""
    rnd, rows = random.Random(12), []
    for d in range(1500):
        rows.append((d, "one common part " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(7))))
    copies = [(2000 + d, rows[d][1].rsplit(" ", 1)[0] + " other") for d in range(0, 1500, 100)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df, hot=100, local=0).collect()} == {(d, d - 2000) for d, _ in copies}


def test_plans_agree(spark):
    df = spark.createDataFrame(corpus(5), "doc_id long, text string")
    want = sorted(map(tuple, near_duplicates(df).collect()))
    assert want == sorted(map(tuple, near_duplicates(df, hot=3, local=0).collect()))


def test_several_texts_of_one_id(spark):
    """Only the rows that have a near-duplicate go; the first is that of the least id, then of the least hash."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (2, b), (3, b + " end"), (3, c), (4, c), (-9, "x y"), (-9, "X  y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == {(2, 1), (3, 2), (4, 3)}
    left = sorted((r.doc_id, r.text) for r in drop_near_duplicates(df).collect())
    assert left[1:] == [(1, a), (2, b), (2, b), (3, c)] and left[0][0] == -9
