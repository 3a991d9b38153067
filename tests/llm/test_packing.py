"""Packing against trying every set of cuts, and as an exact round trip."""

import random
import re
from itertools import combinations

import pytest

from orrery.llm.packing import cuts, pack


def cheapest(bounds, penalties, capacity):
    inner, best = range(1, len(bounds) - 1), None
    for k in range(len(inner) + 1):
        for c in combinations(inner, k):
            at = [0, *c, len(bounds) - 1]
            sizes = [bounds[b] - bounds[a] for a, b in zip(at, at[1:])]
            if max(sizes) <= capacity:
                cost = sum(capacity - s for s in sizes) + sum(penalties[b] for b in at[1:])
                best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_least_cost(seed):
    rnd = random.Random(seed)
    bounds = [0]
    for _ in range(rnd.randrange(1, 11)):
        bounds.append(bounds[-1] + rnd.randrange(1, 11))
    penalties = [0, *(rnd.choice([0, 3, 9]) for _ in bounds[2:]), 0]
    chosen, cost = cuts(bounds, penalties, 12)
    assert cost == cheapest(bounds, penalties, 12) and chosen[-1] == bounds[-1]


def test_round_trip(spark):
    rnd = random.Random(1)
    text = lambda: "".join(f"w{rnd.randrange(99)}" + rnd.choice([" ", " ", " ", ". ", "\n"]) for _ in range(rnd.randrange(0, 60)))
    rows = [(i, text()) for i in range(50)] + [(60, "y " * 333), (None, "x"), (61, None), (62, ""), (63, " "), (64, "a b"), (64, "a b"), (3000, "z")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    got = sorted(pack(df, capacity=32, cut=2, hard=8, shard=16).collect(), key=lambda r: (r.shard, r.window))
    assert all(r.n_words + r.padding == 32 and r.n_words == len(r.text.split()) == sum(r.ends) - sum(r.begins) for r in got)
    assert [w for r in got for w in r.text.split()] == [w for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]) if t for w in t.split()]
    places = [(d, x) for r in got for d, a, z in zip(r.doc_ids, r.begins, r.ends) for x in range(a, z)]
    assert sorted(places) == sorted((i, x) for i, t in rows if i is not None and t for x in range(len(t.split())))
    assert pack(df.limit(0)).count() == 0


def plain_bounds(texts, capacity, cut, hard):
    """Words after which a window may end, with the price, read word by word."""
    bounds, n = {0: 0}, 0
    for t in texts:
        found = list(re.finditer(r"[^\x00-\x20]+", t))
        for m, after in zip(found, [*found[1:], None]):
            n += 1
            if after is None:
                bounds[n] = 0
            elif m[0][-1] in ".!?" or "\n" in t[m.end() : after.start()]:
                bounds[n] = cut
    for a, b in zip(list(bounds), list(bounds)[1:]):
        bounds |= {x: hard for x in range(a + capacity, b, capacity)}
    return dict(sorted(bounds.items()))


def least(bounds, capacity):
    cost, at = {0: 0}, list(bounds)
    for j in at[1:]:
        cost[j] = bounds[j] + min(cost[i] + capacity - (j - i) for i in at if i < j and j - i <= capacity)
    return cost[at[-1]]


def random_rows(seed, ids):
    rnd = random.Random(seed)
    return [(i, "".join(f"w{rnd.randrange(99)}" + rnd.choice([" ", " ", " ", " ", ". ", "!\t", "\n"]) for _ in range(rnd.choice([0, 1, 5, 20, 90])))) for i in ids]


@pytest.mark.parametrize("in_memory", [1 << 20, 0])
@pytest.mark.parametrize("seed", range(3))
def test_windows_cost_the_least_of_their_shard(spark, seed, in_memory):
    """Boundaries and penalties as read word by word; each shard against all ways of cutting it; shards by words of the order."""
    rows = random_rows(seed, range(70))
    got = sorted(pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), capacity=16, cut=3, hard=8, shard=300, in_memory=in_memory).collect(), key=lambda r: (r.shard, r.window))
    shards, n = {}, 0
    for _, t in rows:
        if t.split():
            shards.setdefault(n // 300, []).append(t)
            n += len(t.split())
    assert len(shards) > 2 and {r.shard for r in got} == set(shards)
    for k, own in shards.items():
        bounds, at, cost = plain_bounds(own, 16, 3, 8), 0, 0
        for r in (r for r in got if r.shard == k):
            at += r.n_words
            cost += r.padding + bounds[at]
        assert cost == least(bounds, 16) and " ".join(" ".join(own).split()) == " ".join(" ".join(r.text for r in got if r.shard == k).split())


@pytest.mark.parametrize("in_memory", [1 << 20, 0])
def test_only_the_order_of_ids_matters(spark, in_memory):
    rows = random_rows(9, range(200))
    rnd = random.Random(1)
    new = sorted({rnd.randrange(-(1 << 62), 1 << 62) for _ in range(200)})
    windows = lambda r: sorted((x.shard, x.window, x.text, x.padding) for x in pack(spark.createDataFrame(r, "doc_id long, text string"), capacity=32, shard=500, in_memory=in_memory).collect())
    assert windows(rows) == windows([(new[i], t) for i, t in rows])


@pytest.mark.parametrize("in_memory", [1 << 20, 0])
def test_many_rows_of_one_id(spark, in_memory):
    """They are spread over shards, and repeated ones stay together."""
    rows = [(7, t) for _, t in random_rows(3, range(150))] + [(7, "same words")] * 20
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=32, shard=200, in_memory=in_memory).collect()
    assert len({r.shard for r in got}) > 5 and len({r.shard for r in got if "same words" in r.text}) == 1
    assert sorted(w for r in got for w in r.text.split()) == sorted(w for _, t in rows for w in t.split())
