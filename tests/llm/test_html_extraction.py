"""Tree scoring against a recursive reading of the rule, and pages whose main text is known."""

import random
import re
import time
from xml.etree import ElementTree as ET

import pytest

from orrery.llm.html_extraction import BLOCKS, BOILERPLATE, REACH, START, extract, main_text

WORDS = "one two, three four five six. seven, eight nine ten".split()


def page(seed):
    """A random well-formed tree of div, p, ul, a and nav."""
    rnd = random.Random(seed)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))

    def node(depth):
        kind = rnd.choice(["p", "p", "p", "div", "div", "section", "nav", "ul"]) if depth < 4 else "p"
        if kind == "p":
            return "<p>" + text(rnd.randrange(0, 40)) + (f"<a>{text(rnd.randrange(1, 20))}</a>" if rnd.random() < 0.3 else "") + "</p>"
        return f"<{kind}>" + "".join(node(depth + 1) for _ in range(rnd.randrange(0, 5))) + f"</{kind}>"

    return "<html><body>" + "".join(node(0) for _ in range(5)) + "</body></html>"


def letters(e, in_link=None, dead=False):
    dead = dead or e.tag in BOILERPLATE
    in_link = in_link if in_link is None else in_link or e.tag == "a"
    n = 0 if dead or in_link is False else len((e.text or "").strip(" ")) if (e.text or "").strip() else 0
    return n + sum(letters(c, in_link, dead) for c in e)


def plain_scores(root):
    parent = {c: p for p in root.iter() for c in p}
    scores = {}
    for p in root.iter("p"):
        chain, up = [], p
        while up in parent:
            up = parent[up]
            chain.append(up)
        if any(e.tag in BOILERPLATE for e in chain):
            continue
        n, links = letters(p), letters(p, False)
        if n < 25:
            continue
        points = (1 + "".join(p.itertext()).count(",") + min(n // 100, 3)) * (1 - links / n)
        for level, e in enumerate(chain[:REACH]):
            share = 1 if level == 0 else 1 / 2 if level == 1 else 1 / (2 * (level + 1))
            scores[e] = scores.get(e, START.get(e.tag, 0)) + points * share
    return {e: s * (1 - letters(e, False) / letters(e)) if s > 0 else s for e, s in scores.items() if letters(e)}


def best_score(source):
    return max(plain_scores(ET.fromstring(source)).values(), default=0.0)


def plain_lines(e):
    """Text of an element without boilerplate, a line for each run of text between blocks."""
    if e.tag in BOILERPLATE:
        return ["\n"]
    own = [e.text or "", *(x for c in e for x in plain_lines(c))]
    return own if e.tag == "a" else ["\n", *own, "\n"]


def plain_text(source):
    root = ET.fromstring(source)
    parent, scores = {c: p for p in root.iter() for c in p}, plain_scores(root)
    kept = [root]
    if scores:
        order = list(root.iter())
        best = max(sorted(scores, key=order.index), key=scores.get)
        kept, bar = [], max(10, scores[best] / 5)
        for e in parent[best] if best in parent else [best]:
            n, links = letters(e), letters(e, False)
            if e is best:
                kept.append(e)
            elif n and (scores.get(e, 0) >= bar or e.tag == "p" and (n > 80 and links / n < 0.25 or not links and re.search(r"[.!?](\s|$)", "".join(e.itertext())))):
                kept.append(e)
    lines = "".join(x for e in kept for x in plain_lines(e)).split("\n")
    return "\n".join(x for x in (" ".join(x.split()) for x in lines) if x)


@pytest.mark.parametrize("seed", range(60))
def test_scores(seed):
    source = page(seed)
    assert extract(source)[2] == pytest.approx(best_score(source))


@pytest.mark.parametrize("seed", range(200))
def test_kept_text(seed):
    """The best container and those of its siblings that belong to it, without boilerplate."""
    source = page(seed)
    assert extract(source)[0] == plain_text(source)


def test_ties_go_to_the_first():
    p = "<p>Words enough for a paragraph, with a comma</p>"
    assert extract(f"<body><div><div>{p}one</div></div><div><div>{p}two</div></div></body>")[0].endswith("one")


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 50_000 + "<p>Words enough for a paragraph, yes</p>" * 50_000,
        "<div><p>Words enough for a paragraph, yes</p>" * 50_000,
        "<b>" * 50_000 + "</i>" * 50_000 + "<li>" * 50_000,
        "<b>" * 50_000 + "x<br>" * 50_000,
        "<ul><li>" * 25_000 + "<p>a" * 25_000,
        "<b '>'" * 60_000,
        "<b '" * 100_000,
        '<a ">' * 99_999,
        "<div" * 100_000 + "<!-- x",
    ],
)
def test_time_is_linear_in_hostile_pages(source):
    """Deep and broken pages of a few hundred kB take seconds, not minutes; four times the page takes about four times as long."""
    took = []
    for part in (source[: len(source) // 4], source):
        began = time.process_time()
        extract(part)
        took.append(time.process_time() - began)
    assert took[1] < 10 and took[1] < 9 * took[0] + 1


def test_main_text(spark):
    body = "".join(f"<p>Paragraph {i}, which is long enough to count &amp; has commas, too.<br>Second line.<p>" for i in range(5))
    whole = f"<!DOCTYPE html><html><head><title> A &lt;b&gt; </title><script>if (a<b) '<p>'</script></head><body><nav><ul>{'<li><a href=/>Some, link, here, with, many, commas</a>' * 9}</ul></nav><article><h1>Head</h1>{body}</article><div class='comments'><p>Me, too, I think, so, really, yes, I do.</p></div><footer>End</footer>"
    text = "Head\n" + "\n".join(f"Paragraph {i}, which is long enough to count & has commas, too.\nSecond line." for i in range(5))
    rows = [(1, "u", whole), (2, None, None), (3, "", ""), (None, "u", "<"), (4, "u", "plain <b>text"), (5, "u", "<div" * 500 + ">"), (6, "u", "<p>" + "a, " * 200_000), (7, "u", "<!-- open <p>x"), (1, "u", whole)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "page_id long, url string, html string, score double")
    got = {(r.page_id, r.text if r.page_id != 6 else len(r.text), r.title) for r in main_text(df).collect()}
    assert got == {(1, text, "A <b>"), (2, None, None), (3, "", None), (None, "<", None), (4, "plain text", None), (5, "", None), (6, 599_999, None), (7, "", None)}
    assert main_text(df.limit(0)).count() == 0 and "p" in BLOCKS
