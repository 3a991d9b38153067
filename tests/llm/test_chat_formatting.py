"""Quotation linking: a thread taken apart by hand, and random threads whose replies are known."""

import random
import re
import time

import pytest

from orrery.llm.chat_formatting import conversations, levels, reply_order


def test_reply_order():
    assert reply_order([0, 1, 2, 3, 4], [None, 0, 0, 1, 2]) == [0, 1, 3, 2, 4]
    assert reply_order([0, 0, 1], [None, None, 0]) == [0, 2, 1] and reply_order([], []) == [] and reply_order([3], [3]) == [0]


def test_thread(spark):
    rows = [
        (1, 0, "user", "How does the engine start?\nIs there a manual for it?"),
        (1, 1, "a", "> How does the engine start?\nTurn the key."),
        (1, 2, "b", "On Monday user wrote:\n> how does the   engine START?\n> is there a manual for it?\n\nThere is a manual in the box."),
        (1, 3, "user", "> > How does the engine start?\n> Turn the key.\nThat does nothing at all."),
        (1, 4, "user", ">There is a manual in\n>the box.\n\nFound it."),
        (1, 5, "a", "> never said before this\nSorry."),
        (1, 6, None, None),
        (1, 6, None, None),
        (2, 0, "user", "> How does the engine start?"),
        (None, 0, "user", "x"), (3, None, "user", "x"),
        (4, 0, "user", "y" * 200_000), (4, 1, "a", "> " + "y" * 200_000),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, hash int")
    got = {r.conv_id: r for r in conversations(df).collect()}
    assert set(got) == {1, 2, 4} and got[1].n_messages == 7
    assert [(m.turn, m.reply_to, m.text) for m in got[1].messages] == [
        (0, None, "How does the engine start?\nIs there a manual for it?"), (1, 0, "Turn the key."), (3, 1, "That does nothing at all."),
        (2, 0, "There is a manual in the box."), (4, 2, "Found it."), (5, 4, "Sorry."), (6, 5, ""),
    ]
    assert got[1].messages[6].role == "unknown" and got[2].chat == "<|user|>\n" and got[4].messages[1].reply_to == 0
    assert conversations(df.limit(0)).count() == 0


def test_known_replies(spark):
    rnd, rows, parents = random.Random(2), [], {}
    for c in range(30):
        said = []
        for t in range(rnd.randrange(1, 12)):
            own = " ".join(f"w{rnd.randrange(10_000)}" for _ in range(rnd.randrange(4, 30)))
            p = rnd.randrange(t) if t else None
            quoted = said[p].splitlines() if t else []
            said.append("\n".join([*("> " + x for x in quoted), own]))
            rows.append((c, t, "r", said[-1]))
            parents[c, t] = (p, own)
    rnd.shuffle(rows)
    got = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, m.turn): (m.reply_to, m.text) for r in got for m in r.messages} == parents
    for r in got:
        seen = set()
        for m in r.messages:
            assert m.reply_to is None or m.reply_to in seen
            seen.add(m.turn)


def test_announcements_of_any_length():
    """Who announces a quote belongs to it, however long the line; only before a quote."""
    for line in ("On Monday, " + "x " * 400 + "wrote:", "Frau Y schrieb", "  -----Original Message-----", "From: someone", "A" * 999 + " a écrit :"):
        assert levels(f"{line}\n\n> quoted\nown")[0] == (1, "") and levels(f"{line}\nown")[0][0] == 0
    for line in ("wrote:" + " " * 50_000 + "x", "schrieb " * 20_000 + "x", "on " * 30_000, "--" + " " * 50_000 + "x"):
        began = time.process_time()
        assert levels(f"{line}\n> q")[0][0] == 0
        assert time.process_time() - began < 2


def plain_thread(rows, least=12):
    """{turn: (what is said, replied to)} of one conversation, message by message."""

    def passages(lines):
        plain = [" ".join(x.lower().split()) for x in lines]
        out = {" ".join(x for x in plain if x)} - {""}
        out |= {x for x in plain if len(x) >= least}
        for block in re.split(r"\n{2,}", "\n".join(plain)):
            if len(p := " ".join(x for x in block.split("\n") if x)) >= least:
                out.add(p)
        return out

    said, result = {}, {}
    for turn, text in rows:
        own, quoted, run = [], {}, []
        marked = []
        for line in text.splitlines():
            n = re.match(r"^[ \t]*((?:>[ \t]?)*)", line)
            marked.append((n[1].count(">"), line[n.end() :] if n[1] else line))
        for level, line in [*marked, (None, "")]:
            if run and level != run[0][0]:
                if run[0][0]:
                    quoted.setdefault(run[0][0], set()).update(passages([x for _, x in run]))
                else:
                    own += [x for _, x in run]
                run = []
            run.append((level, line))
        best = None
        for level, units in quoted.items():
            for of, units2 in said.items():
                if letters := sum(len(u) for u in units & units2):
                    best = max(best or (-99, 0, 0), (-level, letters, of))
        result[turn] = (best[2] if best else max(said, default=None))
        said[turn] = passages(own)
    return result


@pytest.mark.parametrize("seed", range(3))
def test_linking_against_a_plain_reading(spark, seed):
    """Quotes of whole messages, paragraphs and lines, at one level and two, of one message and of several, reworded ones and short ones."""
    rnd, rows = random.Random(40 + seed), []
    vocabulary = ["alpha", "beta", "gamma", "delta", "no", "yes", "Of Course", "maybe  so"]
    for c in range(25):
        texts = []
        for t in range(rnd.randrange(1, 9)):
            lines = []
            for _ in range(rnd.randrange(0, 3)):
                if texts:
                    source = [x for x in rnd.choice(texts).split("\n") if not x.startswith(">")]
                    a = rnd.randrange(len(source) + 1)
                    mark = rnd.choice(["> ", ">", "> > ", ">> "])
                    lines += [mark + x.upper() for x in source[a : a + rnd.randrange(1, 4)]]
            lines += [rnd.choice(["", " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 5)))]) for _ in range(rnd.randrange(1, 5))]
            texts.append("\n".join(lines))
            rows.append((c, t, "r", texts[-1]))
    want = {(c, t): of for c in range(25) for t, of in plain_thread([(t, x) for d, t, _, x in rows if d == c]).items()}
    got = conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, m.turn): m.reply_to for r in got for m in r.messages} == want and len({v for v in want.values()}) > 3
