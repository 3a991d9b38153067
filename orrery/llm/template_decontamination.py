"""Benchmark leaks by template canonicalisation, re-parameterised questions included.

Tokens are runs of letters and digits (a run parts where letters meet digits; points and commas between digits belong to a number),
without ASCII and Latin-1 case. Numbers, units after numbers, and runs of capitalised words inside a sentence become the
placeholders <number>, <unit> and <name>. A capitalised word that begins a sentence may be a name or not, so texts are read both ways: as it stands,
and as <name>. Windows of WINDOW template tokens are hash-joined between documents and items within a reading; an item shorter than that is one
window. Windows that would be more than half placeholders say too little: they are joined by their tokens as they stand, so that
copies are still found. Items under SHORT tokens are matched only by documents that consist of the same tokens and no others.

Along one placement of an item in a document (document position less item position), the values in the item's slots and those
in the document's must map to each other one to one: the share of slot tokens that do is the placement's consistency, and a placement
below CONSISTENT is no match. A document leaks an item if, in one of the readings, its consistent placements cover at least COVERAGE of the
item's windows.

Defined results: null, empty and wordless texts and items match nothing; rows without an id are left out (and kept by the filter);
rows that are the same in id and text are one document, different texts of one id are judged apart, and the filter drops only those that leak;
an empty table on either side gives no leaks; long texts are read whole; an item that occurs several times in a document gives one row; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, Scratch, U, keyed, mix, prefix_hashes, small, span_hashes, texts

WINDOW, SHORT, COVERAGE, CONSISTENT = 8, 5, 0.35, 0.8
#: The benchmark's hashes are sent to the scan as a filter if there are at most so many; else every window takes part in the join.
FILTER_HASHES = 4_000_000
FILTER_BITS = 24
UNITS = frozenset(
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds ton tons ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp hz khz mhz ghz w kw mw v kv a ma ohm ohms pa kpa bar j kj cal kcal n kn k c f deg degree degrees mol px b kb mb gb tb kmh mph kph".split()
)
LITERAL, NUMBER, UNIT, NAME = range(4)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\n")] = True
_PLACE = mix(np.arange(101, 105).astype(U))
_AS_IT_STANDS = U(0x1F83D9ABFB41BD6B)


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters in UTF-8."""
    out = FOLD[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    second = buf[lead + 1]
    upper = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1
    out[upper] += 32
    return out


_UNIT_HASHES = np.sort(np.array([span_hashes(prefix_hashes(np.frombuffer(u.encode(), np.uint8)), np.array([0]), np.array([len(u)]))[0] for u in UNITS], U))


def template(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, value hash and kind of each token, each text's first token, and which tokens may be names that begin a sentence."""
    nothing = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int8), np.zeros(len(off), np.int64), np.zeros(0, bool)
    if not len(buf):
        return nothing
    letter, digit = _LETTER[buf], _DIGIT[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    mark = (buf == 46) | (buf == 44)
    mark[1:-1] &= digit[:-2] & digit[2:] & ~edge[1:-2] & ~edge[2:-1]
    mark[[0, -1]] = False
    number = digit | mark
    inside = letter | number
    part = edge[1:-1] | (number[1:] != number[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= part | ~inside[:-1]
    last[:-1] &= part | ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return nothing
    lower = fold(buf)
    at = np.searchsorted(starts, off)
    opens = np.zeros(len(starts), bool)
    opens[at[:-1][at[:-1] < len(starts)]] = True
    stops = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_STOP[buf], out=stops[1:])
    sentence = opens.copy()
    sentence[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    kind = np.where(number[starts], NUMBER, LITERAL).astype(np.int8)
    long = ends - starts > 1
    second = np.minimum(starts + 1, len(buf) - 1)
    latin = (buf[starts] == 0xC3) & (buf[second] != lower[second])
    after = np.minimum(np.where(latin, starts + 2, starts + 1), len(buf) - 1)
    capital = ((buf[starts] != lower[starts]) | latin) & long & (after < ends) & (buf[after] == lower[after]) & ~((buf[after] == 0xC3) & (buf[np.minimum(after + 1, len(buf) - 1)] != lower[np.minimum(after + 1, len(buf) - 1)]))
    kind[capital & ~sentence & (kind == LITERAL)] = NAME
    # a run of capitalised words is one name
    name = kind == NAME
    again = np.zeros(len(starts), bool)
    again[1:] = name[1:] & name[:-1] & ~sentence[1:]
    keep = np.flatnonzero(~again)
    ends = ends[np.append(keep[1:], len(starts)) - 1]
    starts, kind, opens, begins = starts[keep], kind[keep], opens[keep], (capital & sentence)[keep]
    value = span_hashes(prefix_hashes(lower), starts, ends)
    known = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)] == value
    unit = known & (kind == LITERAL)
    unit[1:] &= (kind[:-1] == NUMBER) & ~opens[1:]
    unit[0] = False
    kind[unit] = UNIT
    return np.where(kind == LITERAL, value, _PLACE[kind]), value, kind, np.searchsorted(starts, off), begins & (kind == LITERAL)


def _windows(batches: Iterator[pa.RecordBatch], lengths: list[int], window: int, short: int, wanted: np.ndarray | None, items: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, th, pos, hash, readings (1, 2 or both, 3), slots (offset and value). Items: full windows, or one of all tokens; documents: windows of all lengths."""
    for rows, buf, off in texts(batches):
        hashes, value, kind, at, begins = template(buf, off)
        count = np.diff(at)
        text = np.repeat(np.arange(len(count)), count)
        kinds = kind, np.where(begins, NAME, kind).astype(np.int8)
        sums = prefix_hashes(hashes), prefix_hashes(np.where(begins, _PLACE[NAME], hashes)), prefix_hashes(mix(value ^ _AS_IT_STANDS))
        total = lambda x: np.append(0, np.cumsum(x, dtype=np.int32))
        literal, open_ = [total(k == LITERAL) for k in kinds], total(begins)
        found: list[tuple] = []
        for length in lengths:
            i = np.arange(max(0, len(hashes) - length + 1))
            fits = i + length <= at[1:][text[: len(i)]]
            if items and length < window or length < short:
                fits &= count[text[: len(i)]] == length
            i = i[fits]
            within = lambda x: x[i + length] - x[i]
            telling, both = [2 * within(x) >= length for x in literal], within(open_) == 0
            telling = [x & (length >= short) for x in telling]
            # as it stands, with names that begin sentences, and token by token
            for which, some, readings in ((0, telling[0], np.where(both, 3, 1)), (1, telling[1] & ~both, np.full(len(i), 2)), (2, ~telling[0], np.full(len(i), 3))):
                j, r = i[some], readings[some]
                h = span_hashes(sums[which], j, j + length)
                if wanted is not None:
                    hit = wanted[(h >> U(64 - FILTER_BITS)).astype(np.int64)]
                    j, r, h = j[hit], r[hit], h[hit]
                found.append((j, np.full(len(j), length), h, r, np.full(len(j), which)))
        pos, n, h, r, which = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
        if not len(pos):
            continue
        slots = [[] if w == 2 else [(j - p, int(value[j])) for j in range(p, p + k) if kinds[w][j] != LITERAL] for p, k, w in zip(pos.tolist(), n.tolist(), which.tolist())]
        slots = [[{"at": a, "value": v - (1 << 64) if v >> 63 else v} for a, v in s] for s in slots]
        take = pa.array(text[pos])
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(take), rows.column("th").take(take), pa.array((pos - at[text[pos]]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(r.astype(np.int32)), pa.array(slots, pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int64())])))],
            names=["doc_id", "th", "pos", "hash", "readings", "slots"],
        )


_SCHEMA = "doc_id long, th long, pos int, hash long, readings int, slots array<struct<at:int,value:long>>"


def _lengths(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in texts(batches):
        n = np.minimum(np.diff(template(buf, off)[3]), window)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(n[n > 0]).astype(np.int32))], names=["n"])


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, short: int, coverage: float, consistent: float) -> DataFrame:
    """doc_id, th (the text's hash), item_id, coverage, consistency, windows."""
    docs, items = (keyed(df, i, t).withColumn("th", F.xxhash64("text")) for df, i, t in ((docs, id_col, text_col), (benchmark, item_col, item_text_col)))
    scratch = Scratch(docs.sparkSession)
    lengths = sorted(r.n for r in items.mapInArrow(lambda it: _lengths(it, window), "n int").distinct().collect()) or [window]
    theirs = items.mapInArrow(lambda it: _windows(it, lengths, window, short, None, True), _SCHEMA).drop("th")
    theirs = scratch.save(theirs.withColumnsRenamed({"doc_id": "item_id", "pos": "item_pos", "slots": "item_slots", "readings": "item_readings"}))
    hashes = theirs.select("hash").distinct()
    n, wanted = hashes.count(), None
    if n <= FILTER_HASHES:
        wanted = np.zeros(1 << FILTER_BITS, bool)
        wanted[(hashes.toArrow().column("hash").to_numpy().view(U) >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        wanted = np.packbits(wanted)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _windows(it, lengths, window, short, None if wanted is None else np.unpackbits(wanted).astype(bool), False)

    ours = docs.mapInArrow(scan, _SCHEMA)
    met = ours.join(small(theirs, theirs.count(), 200), "hash").withColumn("readings", F.col("readings").bitwiseAND(F.col("item_readings")))
    reading = F.explode(F.when(F.col("readings") == 3, F.array(F.lit(1), F.lit(2))).when(F.col("readings") > 0, F.array("readings")))
    met = met.select("doc_id", "th", "item_id", (F.col("pos") - F.col("item_pos")).alias("placement"), "item_pos", F.arrays_zip("slots", "item_slots").alias("pairs"), reading.alias("reading"))
    met = scratch.save(met)
    place = ["doc_id", "th", "item_id", "reading", "placement"]
    pair = F.explode("pairs").alias("p")
    slots = met.select(*place, "item_pos", pair).select(*place, (F.col("item_pos") + F.col("p.item_slots.at")).alias("token"), F.col("p.item_slots.value").alias("v"), F.col("p.slots.value").alias("w")).distinct()
    of_v, of_w = Window.partitionBy(*place, "v"), Window.partitionBy(*place, "w")
    held = slots.select(*place, ((F.min("w").over(of_v) == F.max("w").over(of_v)) & (F.min("v").over(of_w) == F.max("v").over(of_w))).cast("double").alias("ok"))
    held = held.groupBy(*place).agg(F.avg("ok").alias("consistency"))
    good = met.drop("pairs").join(held, place, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= consistent)
    found = good.groupBy("doc_id", "th", "item_id", "reading").agg(F.countDistinct("item_pos").alias("windows"), F.min("consistency").alias("consistency"))
    totals = theirs.groupBy("item_id").agg(F.countDistinct("item_pos").alias("total"))
    share = F.col("windows") / F.col("total")
    found = found.join(totals, "item_id").where((share >= coverage) & (F.col("windows") >= F.least(F.lit(2), "total"))).withColumn("coverage", share)
    out = scratch.save(found.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("coverage", "consistency", "windows")).alias("m")).select("doc_id", "th", "item_id", "m.*"))
    scratch.drop_all_but(out)
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, short: int = SHORT, coverage: float = COVERAGE, consistent: float = CONSISTENT
) -> DataFrame:
    """doc_id, item_id, coverage, consistency, windows: every document and item of which it holds enough windows; of several texts of an id the one that covers most."""
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, window, short, coverage, consistent)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "consistency", "windows")).alias("m")).select("doc_id", "item_id", "m.*")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, short: int = SHORT, coverage: float = COVERAGE, consistent: float = CONSISTENT
) -> DataFrame:
    """docs without those rows whose text leaks an item; columns as they were."""
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, window, short, coverage, consistent)
    gone = found.select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct()
    same = (docs[id_col].cast("long") == gone["__gone"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__th"])
    return docs.join(small(gone, gone.count(), 16), same, "left_anti")
