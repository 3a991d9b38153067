"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of > before its text. Runs of lines of one level are passages; lines that only announce a quote ("On ... wrote:")
belong to it. A passage is compared whole, by paragraph and by line, in lower case with single spaces and without the marks, as a 64-bit
hash of at least LEAST letters (a whole text may be shorter). Quoted units join, within the conversation, with equal units of what
earlier messages say themselves. A message replies to the message that its least quote level matches with the most letters, the latest of
equals; one without a match replies to the turn before it. Messages then follow the tree of replies: each is followed by its
replies, in order of turn, each with its own replies.

Defined results: a null text is an empty one; a message of quotes alone has an empty text and stays in its place; rows without a conversation or a
turn are left out; rows that repeat are one message, and different ones of one turn follow each other by role and text, of which the first
is the one replied to; a null role is 'unknown'; an empty table gives no conversations; quotes of unknown origin are dropped like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAST = 12
_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_ANNOUNCE = re.compile(r"(?:on\b.*\bwrote|.*\b(?:schrieb|a écrit|escribió)|-{2,}\s*+original message\s*+-{2,}|from:.*)\s*+(?::\s*+)?$", re.I)
_SPACE = re.compile(r"\s+")
MESSAGE = "array<struct<turn:long,role:string,text:string,reply_to:long>>"


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, text without marks) of each line; an announcement has the level of the quote that follows it."""
    out: list[tuple[int, str]] = []
    for line in text.splitlines():
        m = _QUOTE.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    for i in range(len(out) - 2, -1, -1):
        if _ANNOUNCE.match(out[i][1].strip()) and (next_ := next((x for x in out[i + 1 :] if x[1].strip() or x[0]), None)) and next_[0] > out[i][0]:
            out[i] = (next_[0], "")
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def units(lines: list[str], least: int) -> dict[int, int]:
    """Hash and letters of a passage's whole, paragraphs and lines."""
    plain = [_SPACE.sub(" ", x).strip().lower() for x in lines]
    whole = " ".join(x for x in plain if x)
    if not whole:
        return {}
    out, paragraph = {_hash(whole): len(whole)}, []
    for x in [*plain, ""]:
        if x:
            paragraph.append(x)
            if len(x) >= least:
                out.setdefault(_hash(x), len(x))
        elif paragraph:
            if len(p := " ".join(paragraph)) >= least:
                out.setdefault(_hash(p), len(p))
            paragraph = []
    return out


def parsed(text: str, least: int = LEAST) -> tuple[str, dict[int, int], list[tuple[int, int, int]]]:
    """What a message says itself, the units of that, and its quotes as (level, hash, letters)."""
    marked = levels(text)
    quotes: dict[tuple[int, int], int] = {}
    i = 0
    while i < len(marked):
        j = i
        while j < len(marked) and marked[j][0] == marked[i][0]:
            j += 1
        if marked[i][0]:
            for h, n in units([x for _, x in marked[i:j]], least).items():
                quotes.setdefault((marked[i][0], h), n)
        i = j
    if not any(level for level, _ in marked):
        return text.strip(), units(text.splitlines(), least), []
    own = [x for level, x in marked if not level]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), units(own, least), [(level, h, n) for (level, h), n in quotes.items()]


def _parse(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    unit = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("letters", pa.int32())]))
    for b in batches:
        rows = [parsed(t or "", least) for t in b.column("text").to_pylist()]
        own = pa.array([[{"level": 0, "hash": h, "letters": n} for h, n in u.items()] for _, u, _ in rows], unit)
        quotes = pa.array([[{"level": a, "hash": h, "letters": n} for a, h, n in q] for _, _, q in rows], unit)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([t for t, _, _ in rows], pa.string()), own, quotes], names=["conv_id", "turn", "role", "text", "own", "quotes"])


def reply_order(turns: list[int], parents: list[int | None]) -> list[int]:
    """Positions in order of the reply tree; messages come by rising turn, parents are turns."""
    place: dict[int, int] = {}
    for i, t in enumerate(turns):
        place.setdefault(t, i)
    children: dict[int, list[int]] = {}
    for i, p in enumerate(parents):
        at = place.get(p, -1) if p is not None else -1
        children.setdefault(at if at < i else -1, []).append(i)
    out, stack = [], children.get(-1, [])[::-1]
    while stack:
        out.append(i := stack.pop())
        stack += children.get(i, [])[::-1]
    return out


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """conv_id, n_messages, messages (turn, role, text, reply_to), and chat: the messages as <|role|>, text and a line's end."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null and turn is not null")
    unit = "array<struct<level:int,hash:long,letters:int>>"
    # parsed once: three branches of the plan read it
    parsed_ = Scratch(messages.sparkSession).save(rows.distinct().mapInArrow(lambda it: _parse(it, least), f"conv_id long, turn long, role string, text string, own {unit}, quotes {unit}"))
    quoted = parsed_.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.hash").alias("hash"), "q.level", "q.letters")
    said = parsed_.select("conv_id", F.col("turn").alias("of"), F.explode("own.hash").alias("hash")).distinct()
    met = quoted.distinct().join(said, ["conv_id", "hash"]).where("of < turn")
    match = met.groupBy("conv_id", "turn", "of", "level").agg(F.sum("letters").alias("letters"))
    link = match.groupBy("conv_id", "turn").agg(F.max_by("of", F.struct(-F.col("level"), "letters", "of")).alias("linked"))
    joined = parsed_.drop("own", "quotes").join(link, ["conv_id", "turn"], "left")
    whole = joined.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "linked"))).alias("all"))

    def ordered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        message = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("reply_to", pa.int64())]))
        for b in it:
            out, chats = [], []
            for all_ in b.column("all").to_pylist():
                turns = [m["turn"] for m in all_]
                distinct = sorted(set(turns))
                before = dict(zip(distinct[1:], distinct))
                parents = [m["linked"] if m["linked"] is not None else before.get(m["turn"]) for m in all_]
                rows = [{"turn": all_[i]["turn"], "role": all_[i]["role"], "text": all_[i]["text"], "reply_to": parents[i]} for i in reply_order(turns, parents)]
                out.append(rows)
                chats.append("".join(f"<|{m['role']}|>{m['text']}\n" for m in rows))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(np.array([len(x) for x in out], np.int64)), pa.array(out, message), pa.array(chats, pa.string())], names=["conv_id", "n_messages", "messages", "chat"])

    return whole.mapInArrow(ordered, f"conv_id long, n_messages long, messages {MESSAGE}, chat string")
