"""Leaks against a plain reading of the rule, and planted re-parameterised questions."""

import random
import re

import pytest

from orrery.llm.template_decontamination import UNITS, decontaminate, leaks

ITEM = "A train leaves Berlin at 30 km per hour while the second leaves 45 minutes later from Paris and goes 30 km farther"


def got(spark, docs, items):
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, hash string")
    b = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, pos int")
    found = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    kept = sorted((r.doc_id or 0, r.text or "") for r in decontaminate(d, b).collect())
    gone = {a for a, _ in found}
    assert [x for x in kept if x[0] not in gone] == sorted((i or 0, t or "") for i, t in docs if i not in gone)
    assert all(sum(k[0] == i for k in kept) < sum(j == i for j, _ in docs) for i in gone)
    return found


def test_slots(spark):
    rnd = random.Random(4)
    noise = lambda n: " ".join(f"n{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(n))
    docs = [
        (1, noise(40) + ". " + ITEM + ". " + noise(40)),
        (2, noise(9) + ". " + ITEM.replace("30", "7,5").replace("45", "12").replace("Berlin", "New York").replace("Paris", "Rome")),
        (3, noise(9) + ". " + ITEM.replace("30", "7", 1).replace("45", "12")),  # the two 30s part
        (4, noise(200)),
        (5, ITEM.upper()),
        (6, None), (7, ""), (None, ITEM), (8, "  "), (9, noise(30_000) + " " + ITEM), (9, noise(3)),
    ]
    items = [(10, ITEM), (11, None), (12, ""), (13, "one two three four"), (14, noise(6)), (None, ITEM), (15, "5 6 7 8 9 10 11 12 13")]
    docs.append((16, "before " + items[4][1] + " after"))
    found = got(spark, docs, items)
    assert {(1, 10), (2, 10), (9, 10), (16, 14)} <= found and not {d for d, _ in found} & {3, 4, 6, 7, 8}
    assert got(spark, docs[:3], []) == set() and got(spark, [], items) == set()


def test_brute_force(spark):
    """Literal tokens only: an item leaks where enough of its windows stand in a document."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("xyzuv") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(5, 40)))) for i in range(30)]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        for _ in range(2):
            t = rnd.choice(items)[1].split()
            a = rnd.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[a : a + rnd.randrange(1, 40)]
        docs.append((d, " ".join(w)))
    want = set()
    for d, t in docs:
        w = t.split()
        for i, q in items:
            v = q.split()
            n = min(8, len(v))
            windows = [v[a : a + n] for a in range(len(v) - n + 1)]
            there = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
            hit = sum(tuple(x) in there for x in windows)
            if hit >= 0.35 * len(windows) and hit >= min(2, len(windows)):
                want.add((d, i))
    assert got(spark, docs, items) == want


def plain_tokens(text):
    """(value, kind, may be a name that begins a sentence) of each token."""
    out, end = [], None
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[a-z]+", text, re.I):
        begins = end is None or re.search(r"[.!?:;\n]", text[end : m.start()]) is not None
        t, end = m[0], m.end()
        capital = len(t) > 1 and t[0].isupper() and t[1].islower()
        if t[0].isdigit():
            out.append([t, "number", False])
        elif capital and not begins:
            if out and out[-1][1] == "name":
                out[-1][0] += text[end - len(t) - 1 : end].lower()
            else:
                out.append([t.lower(), "name", False])
        elif t.lower() in UNITS and out and out[-1][1] == "number":
            out.append([t.lower(), "unit", False])
        else:
            out.append([t.lower(), "literal", capital and begins])
    return out


def plain_windows(tokens, n, reading):
    """Position, what is joined, and slots of each run of n tokens."""
    kinds = ["name" if b and reading == 2 else k for _, k, b in tokens]
    for p in range(len(tokens) - n + 1):
        own = [(t[0], k) for t, k in zip(tokens[p : p + n], kinds[p : p + n])]
        plain = [k for _, k, _ in tokens[p : p + n]]
        if 2 * plain.count("literal") < n or n < 5:
            yield p, ("as it stands", *(v for v, _ in own)), {}
        if n >= 5 and 2 * [k for _, k in own].count("literal") >= n:
            yield p, tuple(v if k == "literal" else f"<{k}>" for v, k in own), {p + i: v for i, (v, k) in enumerate(own) if k != "literal"}


def plain_leaks(docs, items):
    out = set()
    for i, q in items:
        item = plain_tokens(q)
        n = min(8, len(item))
        total = len({p for reading in (1, 2) for p, _, _ in plain_windows(item, n, reading)}) if n else 0
        for d, t in docs:
            doc = plain_tokens(t)
            if not n or n < 5 and len(doc) != n:
                continue
            for reading in (1, 2):
                places = {}
                for p, h, slots in plain_windows(item, n, reading):
                    for p2, h2, slots2 in plain_windows(doc, n, reading):
                        if h == h2:
                            place = places.setdefault(p2 - p, (set(), set()))
                            place[0].add(p)
                            place[1].update((k, v, slots2[k + p2 - p]) for k, v in slots.items())
                covered = set()
                for own, pairs in places.values():
                    ok = [len({w for _, x, w in pairs if x == v}) == 1 == len({x for _, x, y in pairs if y == w}) for _, v, w in pairs]
                    if not ok or sum(ok) / len(ok) >= 0.8:
                        covered |= own
                if total and len(covered) >= 0.35 * total and len(covered) >= min(2, total):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_brute_force_of_placeholders(spark, seed):
    """Numbers, units, names inside and at the beginning of sentences, short and placeholder-heavy items, against a plain reading token by token."""
    rnd = random.Random(20 + seed)
    names, words, units = ["Ann", "Bob", "Cleo", "Dan Lee"], ["buys", "has", "and", "then", "sells", "more", "apples", "left", "of", "the"], ["km", "kg", "hours"]

    def sentence():
        w = [rnd.choice(names) if rnd.random() < 0.4 else rnd.choice(words).capitalize()]
        for _ in range(rnd.randrange(1, 9)):
            w += [rnd.choice(words)] if rnd.random() < 0.6 else [str(rnd.randrange(30))] + [rnd.choice(units)] * (rnd.random() < 0.5) if rnd.random() < 0.6 else [rnd.choice(names)]
        return " ".join(w) + rnd.choice([".", "?", ";", "\n"])

    items = [(i, " ".join(sentence() for _ in range(rnd.choice([1, 2, 4])))) for i in range(25)] + [(30, "Ann 5 7"), (31, "3 4 5 6 7 8 9 10 11"), (32, "of")]
    docs = []
    for d in range(70):
        q = rnd.choice(items)[1]
        if rnd.random() < 0.6:  # other values, here and there not one to one
            to = {x: rnd.choice(["Ann", "Bob", "Cleo", "Eve"]) for x in ("Ann", "Bob", "Cleo")}
            q = re.sub(r"Ann|Bob|Cleo", lambda m: to[m[0]], q)
            shift = rnd.randrange(9)
            q = re.sub(r"\d+", lambda m: str(int(m[0]) + shift + (rnd.random() < 0.1)), q)
        docs.append((d, q if rnd.random() < 0.3 else f"{sentence()} {q} {sentence()}"))
    want = plain_leaks(docs, items)
    assert got(spark, docs, items) == want and len(want) > 30


def test_names_that_begin_sentences(spark):
    item = "Alice buys 5 apples. Alice eats 2. How many are left?"
    docs = [(1, item.replace("Alice", "Bob").replace("5", "9")), (2, item), (3, "Bob buys 9 apples. Carol eats 4. Dan asks how many pears there are")]
    assert got(spark, docs, [(1, item)]) == {(1, 1), (2, 1)}


def test_items_of_numbers_and_short_items(spark):
    items = [(1, "Compute 37 * 48 + 19 - 5 / 2"), (2, "What is it"), (3, "Paris")]
    docs = [(1, "Well. Compute 37 * 48 + 19 - 5 / 2 now"), (2, "Compute 38 * 48 + 19 - 5 / 2"), (3, "what is it?"), (4, "what is it then"), (5, "Paris"), (6, "In Paris it rains")]
    assert got(spark, docs, items) == {(1, 1), (3, 2), (5, 3)}


def test_texts_of_one_id_are_judged_apart(spark):
    rows = [(1, ITEM), (1, "something else"), (1, "something else")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate(d, b).collect()] == rows[1:] and leaks(d, b).count() == 1
