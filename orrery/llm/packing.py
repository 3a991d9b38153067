"""Order-preserving packing: window cuts at document or sentence ends by dynamic programming.

Documents are taken in order of id, in shards of about SHARD words of that order: a document belongs to the shard in which its first word
falls. So shards depend on the order of the ids alone, not on their values or gaps or on how Spark splits the table, and are packed
independently of each other. Length is counted in words. A window holds at most CAPACITY words and may
end at a document's end for nothing, at a sentence's end for CUT, or, inside a sentence longer than a window, every
CAPACITY words for HARD. The windows of a shard minimise padding words plus these penalties:

    f(j) = penalty(j) + min over i of f(i) + CAPACITY - (b(j) - b(i)),  b(j) - b(i) <= CAPACITY

whose minimum of f(i) + b(i) over a sliding range of i is kept in a monotone queue: linear in the number of boundaries.
Of equal choices the longest window wins.

Defined results: null, empty and blank texts hold no word and appear in no window; rows without an id are left out; rows that repeat
are each packed, side by side in one shard; those of one id are ordered by a hash of their text, and by text; an empty table gives no windows;
long texts are packed whole; other columns don't matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, keyed, texts, words

CAPACITY, CUT, HARD, SHARD = 2048, 64, 256, 1 << 20
SCHEMA = "shard long, window int, doc_ids array<long>, begins array<int>, ends array<int>, n_words int, padding int, text string"
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def cuts(bounds: list[int], penalties: list[int], capacity: int) -> tuple[list[int], int]:
    """The chosen bounds, and their cost. bounds rise from 0 in steps of at most capacity; penalties[j] is the price of a cut at bounds[j]."""
    n = len(bounds)
    cost, back = [0] * n, [0] * n
    queue = deque([0])  # bounds by rising cost + bound; the front is the least in reach
    value = [0] * n
    for j in range(1, n):
        b = bounds[j]
        while b - bounds[queue[0]] > capacity:
            queue.popleft()
        i = back[j] = queue[0]
        c = cost[j] = value[i] + capacity - b + penalties[j]
        v = value[j] = c + b
        while queue and value[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    chosen, j = [], n - 1
    while j:
        chosen.append(bounds[j])
        j = back[j]
    return chosen[::-1], cost[-1]


def boundaries(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, capacity: int, cut: int, hard: int) -> tuple[list[int], list[int]]:
    """Word numbers at which a window may end, and the price of each."""
    n = len(starts)
    lines = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf == 10, out=lines[1:])
    stop = _STOP[buf[ends - 1]]
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    price = np.full(n + 1, -1, np.int64)
    price[1:][stop] = cut
    price[at] = 0
    bounds = np.flatnonzero(price >= 0)
    for i in np.flatnonzero(np.diff(bounds) > capacity):
        price[bounds[i] + capacity : bounds[i + 1] : capacity] = hard
    bounds = np.flatnonzero(price >= 0)
    return bounds.tolist(), price[bounds].tolist()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in texts(batches):
        n = np.diff(words(buf, off)[2])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(some)) for c in ("doc_id", "th")), pa.array(n[some].astype(np.int64))], names=["doc_id", "th", "n"])


def _numbered(rows: DataFrame, shard: int, scratch: Scratch) -> DataFrame:
    """doc_id, th, shard of each row that has words.

    Rows are range-partitioned once and stored with their partition's number; the words before each row are then those of the
    partitions before, of which there is one number each, and of the rows before in its own."""
    counted = scratch.save(rows.mapInArrow(_counted, "doc_id long, th long, n long"))
    ranged = scratch.save(counted.repartitionByRange("doc_id", "th").withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("part").agg(F.sum("n")).collect())):
        offsets.append((part, before))
        before += n
    own = F.sum("n").over(Window.partitionBy("part").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    place = ranged.withColumn("own", F.coalesce(own, F.lit(0))).join(F.broadcast(offsets), "part")
    out = scratch.save(place.select("doc_id", "th", F.floor((F.col("before") + F.col("own")) / F.lit(shard)).cast("long").alias("shard")))
    scratch.drop(counted, ranged)
    return out


def _sharded(rows: DataFrame, shard: int, in_memory: int) -> DataFrame:
    """rows with their shard. The shards' first rows are looked up where they are few enough to be held; else the rows join their numbers."""
    numbered = _numbered(rows, shard, Scratch(rows.sparkSession))
    firsts = numbered.groupBy("shard").agg(F.min(F.struct("doc_id", "th")).alias("f"))
    n = firsts.count()
    if not n:
        return rows.withColumn("shard", F.lit(0).cast("long")).where("false")
    if 24 * n > in_memory:
        return rows.join(numbered.groupBy("doc_id", "th").agg(F.max("shard").alias("shard")), ["doc_id", "th"])
    table = firsts.select("f.doc_id", "f.th", "shard").toArrow().sort_by([("doc_id", "ascending"), ("th", "ascending"), ("shard", "ascending")])
    held = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("doc_id", "th", "shard")))

    @F.arrow_udf("long")
    def of(doc_id: pa.Array, th: pa.Array) -> pa.Array:
        ids, hashes, number = held.value
        d, t = doc_id.to_numpy(zero_copy_only=False), th.to_numpy(zero_copy_only=False)
        low, at = np.searchsorted(ids, d), np.searchsorted(ids, d, "right")
        for i in np.flatnonzero(at > low):  # rows of an id with which a shard begins
            at[i] = low[i] + np.searchsorted(hashes[low[i] : at[i]], t[i], "right")
        return pa.array(number[np.maximum(at - 1, 0)])

    return rows.withColumn("shard", of("doc_id", "th"))


def pack_shard(table: pa.Table, capacity: int, cut: int, hard: int) -> list[tuple]:
    table = table.sort_by([(c, "ascending") for c in ("doc_id", "th", "text")])
    out: list[tuple] = []
    for rows, buf, off in texts(iter(table.combine_chunks().to_batches()), size=1 << 60):
        starts, ends, at = words(buf, off)
        if not len(starts):
            continue
        some = np.flatnonzero(np.diff(at))
        ids, first = np.asarray(rows.column("doc_id"))[some], at[some]
        raw, begin = memoryview(buf), 0
        doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        for end in cuts(*boundaries(buf, starts, ends, at, capacity, cut, hard), capacity)[0]:
            d = np.arange(doc[begin], doc[end - 1] + 1)
            a = np.maximum(first[d], begin)
            z = np.minimum(np.append(first[1:], len(starts))[d], end)
            parts = [bytes(raw[x:y]) for x, y in zip(starts[a].tolist(), ends[z - 1].tolist())]
            out.append((len(out), ids[d].tolist(), (a - first[d]).tolist(), (z - first[d]).tolist(), end - begin, capacity - (end - begin), b"\n\n".join(parts).decode()))
            begin = end
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cut: int = CUT, hard: int = HARD, shard: int = SHARD, in_memory: int = BROADCAST_BYTES) -> DataFrame:
    """Windows: shard, window, doc_ids with the words from begins to ends of each, n_words, padding, and the text, documents parted by an empty line."""
    types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.string())

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        rows = pack_shard(table.select(["doc_id", "th", "text"]), capacity, cut, hard)
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(rows), pa.int64()), *columns], names=["shard", "window", "doc_ids", "begins", "ends", "n_words", "padding", "text"])

    rows = keyed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return _sharded(rows, shard, in_memory).groupBy("shard").applyInArrow(packed, SCHEMA)
