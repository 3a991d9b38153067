"""Repeated passages by prefix-partitioned suffix trees.

A window of `least` words that also stands earlier (by id, then position) is repeated; a document's repeated passages are the
union of its repeated windows. Words are compared exactly, white space between them isn't.

Method. Of every window the run of PREFIX words with the least hash is an anchor, so windows that are equal have equal
anchors at equal offsets. Anchors that occur once can't lie in a repeat. Of the others, an anchor that every occurrence reaches
from the same anchor before it only continues a repeat; where occurrences come from different text, and at one anchor in BREAK, chosen by
its hash, suffixes begin. (Windows that repeat an earlier one of their own text are found within it, and have no anchors.) These
suffixes, each cut where the next one takes over, so that they are some hundred words long however long the repeat, and led by the few words that
may precede the anchor in a window, go to groups by prefix: the anchor's words. In a group, for each begin at which left contexts part, the
suffixes are sorted and their common prefixes merged from the deepest up: every merge is an internal node of the suffix tree, and those at
least `least` deep are the maximal repeats. Each suffix but the first of a node is repeated to the node's depth. Here texts are compared
by single words.

Where more than HOT suffixes would share an anchor, the prefix is lengthened to a whole window for each begin that can hold it. Suffixes of
equal prefixes of that length are all repeats of the first, and what a deeper node would add are windows that begin later and have prefixes of
their own; so the first is found by an aggregation, which combines before it shuffles, and no group is held. These windows are compared by two 64-bit hashes.
They come from the pass that makes the suffixes and travel with these, so that no text is exchanged again for them.

Defined results: null, empty and short texts have no repeats; rows without an id are left out (and kept by the cut); rows with
the same id and text are one document; documents with the same id and different texts are told apart by a hash of the text; the first
of equal passages, also within one document, is kept; an empty table gives no repeats; long texts are read whole; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, U, keyed, mix, prefix_hashes, small, span_hashes, texts, word_hashes, words

LEAST, PREFIX, HOT, BREAK = 50, 16, 4096, 32
_NONE = U(0xFFFFFFFFFFFFFFFF)
_SUFFIX = ["key", "doc_id", "th", "pos", "right", "left", "more", "upto", "k1", "k2"]
_FOUND = ["doc_id", "th", "begin", "end", "first_doc", "first_begin", "k1", "k2"]


def anchors(w: np.ndarray, at: np.ndarray, least: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors in w (texts begin at `at`), the hash sums of w, each anchor's text, and the windows that stand earlier in their own text.

    The latter need no anchor: whatever else they equal, their first copy in the text equals too."""
    sums = prefix_hashes(w)
    n, reach = len(w), least - prefix + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, sums, none, none
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][text]
    i = np.arange(n - prefix + 1)
    h = span_hashes(sums, i, i + prefix)
    h[i + prefix > end[: len(i)]] = _NONE
    begin = np.flatnonzero(np.arange(n - least + 1) + least <= end[: n - least + 1])
    own = span_hashes(sums, begin, begin + least) ^ mix(text[begin].astype(U) + U(1))
    by = np.argsort(own, kind="stable")
    again = np.zeros(len(begin), bool)
    j = 1 + np.flatnonzero(own[by[1:]] == own[by[:-1]])
    for k in range(0, len(j), 1 << 14):  # word by word
        some = j[k : k + (1 << 14)]
        x, y = (begin[by[i]][:, None] + np.arange(least) for i in (some, some - 1))
        again[by[some[(w[x] == w[y]).all(axis=1)]]] = True
    again, begin = begin[again], begin[~again]
    best = np.lib.stride_tricks.sliding_window_view(h, reach)[: n - least + 1].argmin(axis=1)
    pos = np.unique(begin + best[begin])
    return pos, sums, text[pos], again


def _anchored(batches: Iterator[pa.RecordBatch], least: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Anchors, and with `upto` what a text repeats of itself."""
    names = ["fp", "link", "r", "l", "doc_id", "th", "pos", "upto"]
    for rows, buf, off in texts(batches):
        starts, ends, at = words(buf, off)
        pos, sums, text, again = anchors(word_hashes(buf, starts, ends), at, least, prefix)
        if not len(pos):
            continue
        first = np.ones(len(pos), bool)
        first[1:] = (text[1:] != text[:-1]) | (pos[1:] - pos[:-1] > least - prefix + 1)
        before = np.where(first, pos, np.roll(pos, 1))
        link = span_hashes(sums, before, pos + prefix).view(np.int64)
        half = (least - prefix + 1) // 2
        short, late = pos + prefix + half > at[text + 1], pos - half < at[text]
        right = span_hashes(sums, pos, np.where(short, pos, pos + prefix + half)).view(np.int64)
        left = span_hashes(sums, np.where(late, pos, pos - half), pos + prefix).view(np.int64)
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(span_hashes(sums, pos, pos + prefix).view(np.int64)), pa.array(link, mask=first), pa.array(right, mask=short), pa.array(left, mask=late), rows.column("doc_id").take(take), rows.column("th").take(take), pa.array((pos - at[text]).astype(np.int32)), pa.nulls(len(pos), pa.int32())],
            names=names,
        )
        if len(again):
            of = np.searchsorted(at, again, "right") - 1
            new = np.ones(len(again), bool)
            new[1:] = (of[1:] != of[:-1]) | (again[1:] > again[:-1] + least)
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(again)) - 1
            none, take = pa.nulls(len(a), pa.int64()), pa.array(of[a])
            doc, th = rows.column("doc_id").take(take), rows.column("th").take(take)
            yield pa.RecordBatch.from_arrays([th, none, none, none, doc, th, pa.array((again[a] - at[of[a]]).astype(np.int32)), pa.array((again[z] + least - at[of[a]]).astype(np.int32))], names=names)


def _suffixes(batches: Iterator[pa.RecordBatch], least: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Suffixes by anchor, and what a text repeats of itself; at hot anchors windows, with k1 and k2."""
    reach = least - prefix + 1
    for rows, buf, off in texts(batches):
        starts, ends, at = words(buf, off)
        # one space after each word; bytes then sort as words do
        length = ends - starts
        where = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(length + 1, out=where[1:])
        plain = np.full(where[-1], 32, np.uint8)
        plain[np.arange(int(length.sum())) + np.repeat(np.arange(len(starts)), length)] = buf[buf > 32]
        plain = plain.tobytes()
        out: list[tuple] = []
        for r, (doc, th, marks) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("th").to_pylist(), rows.column("marks").to_pylist())):
            lo, hi = int(at[r]), int(at[r + 1])
            out += [(lo, doc, th, m["pos"], None, None, None, m["upto"]) for m in marks if m["upto"]]
            marks = sorted({(m["pos"], m["begins"], m["hot"]) for m in marks if not m["upto"]})
            # what continues a hot anchor's repeat begins anew, since that one has no suffix
            begins = [b or j > 0 and marks[j - 1][2] and p - marks[j - 1][0] <= reach for j, (p, b, _) in enumerate(marks)]
            stop, alike = 0, {}
            for j in range(len(marks) - 1, -1, -1):
                p, _, hot = marks[j]
                if j + 1 == len(marks) or marks[j + 1][0] - p > reach:
                    stop = p + least
                elif begins[j + 1]:
                    stop = marks[j + 1][0] - 1 + least
                if not begins[j] or hot:
                    continue
                e, b = min(hi, lo + stop), max(lo, lo + p - reach + 1)
                if e - b >= least:
                    row = (plain[where[lo + p] : where[e]], plain[where[b] : where[lo + p]])
                    alike.setdefault(row, []).append(p)
            out += [(lo + ps[-1], doc, th, ps[-1], right, left, ps[:-1], None) for (right, left), ps in alike.items()]  # ps fall
        if out:
            anchor, doc, th, pos, right, left, more, upto = zip(*out)
            anchor = np.array(anchor)
            key = span_hashes(prefix_hashes(word_hashes(buf, starts, ends)), anchor, np.minimum(anchor + prefix, len(starts))).view(np.int64)
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(pos, pa.int32()), pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(more, pa.list_(pa.int32())), pa.array(upto, pa.int32()), none, none],
                names=_SUFFIX,
            )
        if (windows := _hot_windows(rows, word_hashes(buf, starts, ends), at, least, reach)) is not None:
            yield windows


def _hot_windows(rows: pa.RecordBatch, w: np.ndarray, at: np.ndarray, least: int, reach: int) -> pa.RecordBatch | None:
    """Every window that holds a hot anchor, by two hashes of its words, under keys that spread them evenly."""
    begin, text = [], []
    for r, marks in enumerate(rows.column("marks").to_pylist()):
        if hot := [m["pos"] for m in marks if m["hot"] and not m["upto"]]:
            b = np.unique(at[r] + np.array(hot)[:, None] - np.arange(reach))
            b = b[(b >= at[r]) & (b + least <= at[r + 1])]
            begin.append(b)
            text.append(np.full(len(b), r))
    if not begin:
        return None
    begin, text = np.concatenate(begin), np.concatenate(text)
    k1, k2 = (span_hashes(prefix_hashes(x), begin, begin + least) for x in (w, w ^ U(0x5DEECE66D)))
    th, n, take = np.asarray(rows.column("th")).view(U)[text], len(begin), pa.array(text)
    return pa.RecordBatch.from_arrays(
        [pa.array(mix(k1 ^ mix(th)).view(np.int64)), rows.column("doc_id").take(take), rows.column("th").take(take), pa.array((begin - at[text]).astype(np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.int32()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))],
        names=_SUFFIX,
    )


def _common(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    i = int(differ.argmax()) if n else 0
    return i if n and differ[i] else n


def deep_nodes(order: list, depths: list, ranks: list, least: int) -> Iterator[tuple[int, int, int]]:
    """(suffix, first, depth) for each suffix that isn't the first below some node of at least that depth, by its deepest such node.

    order: the suffixes as sorted; depths: common prefix of each with the one after it; ranks: which occurs first."""
    parent = list(range(len(order)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for j in sorted((j for j, d in enumerate(depths) if d >= least), key=lambda j: -depths[j]):
        a, b = top(j), top(j + 1)  # each root is the first suffix of its subtree
        if ranks[order[a]] > ranks[order[b]]:
            a, b = b, a
        parent[b] = a
        yield order[b], order[a], depths[j]


def subtree(ids: list[tuple], rights: list[np.ndarray], lefts: list[np.ndarray], least: int) -> Iterator[tuple]:
    """(id, begin, depth, id of the first) for the repeats among one group's suffixes; ids are (doc, text, position)."""
    n, in_order = len(ids), lambda x: x.astype(">u8").tobytes()
    if n == 2:
        by, shared = None, [_common(lefts[0], lefts[1])]
    else:
        by = sorted(range(n), key=lambda i: in_order(lefts[i]))
        shared = sorted({_common(lefts[i], lefts[j]) for i, j in zip(by, by[1:])})
    for a in shared:  # at these begins left contexts part; lefts are reversed
        own = [i for i in range(n) if len(lefts[i]) >= a]
        suffix = {i: np.concatenate((lefts[i][:a][::-1], rights[i])) for i in own}
        order = own if len(own) == 2 else sorted(own, key=lambda i: in_order(suffix[i]))
        depths = [_common(suffix[i], suffix[j]) for i, j in zip(order, order[1:])]
        for i, first, depth in deep_nodes(order, depths, ids, least):
            yield ids[i], ids[i][2] - a, depth, ids[first], ids[first][2] - a


def _repeats(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and text; equal texts are held once. Windows pass through."""
    key, ids, rights, lefts, found = None, [], [], [], []

    def flush() -> pa.RecordBatch:
        rows = [(i[0], i[1], b, b + d, f[0], fb) for i, b, d, f, fb in found if i != f or b != fb]
        found.clear()
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(rows), pa.int64())] * 2], names=_FOUND)

    def hashes(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, buf, off in texts(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
            s, e, at = words(buf, off)
            h = word_hashes(buf, s, e)
            out += [h[i:j] for i, j in zip(at, at[1:])]
        return out

    for b in batches:
        window = b.column("k1").is_valid()
        if n := window.true_count:
            w = b.filter(window)
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([w.column("doc_id"), w.column("th"), w.column("pos"), *none, w.column("k1"), w.column("k2")], names=_FOUND)
            b = b.filter(b.column("k1").is_null())
        right, left = hashes(b.column("right")), hashes(b.column("left"))
        for i, (k, doc, th, pos, more, upto) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "th", "pos", "more", "upto")))):
            if upto is not None:
                found.append(((doc, th, pos), pos, upto - pos, (doc, th, -1), -1))
                continue
            if k != key:
                if len(ids) > 1:
                    found.extend(subtree(ids, rights, lefts, least))
                key, ids, rights, lefts = k, [], [], []
                seen: set = set()
            if (doc, th, pos) in seen:
                continue
            seen.add((doc, th, pos))
            ids.append((doc, th, pos))
            for p in more or ():  # the same text again in the same document
                found.append(((doc, th, p), p - len(left[i]), len(left[i]) + len(right[i]), ids[-1], pos - len(left[i])))
            rights.append(rights[-1] if rights and np.array_equal(rights[-1], right[i]) else right[i].copy())
            reverse = left[i][::-1]
            lefts.append(lefts[-1] if lefts and np.array_equal(lefts[-1], reverse) else reverse.copy())
        yield flush()
    if len(ids) > 1:
        found.extend(subtree(ids, rights, lefts, least))
    yield flush()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")


def repeats(docs: DataFrame, id_col: str, text_col: str, least: int, prefix: int, hot: int) -> tuple[DataFrame, Scratch]:
    """doc_id, th (the text's hash), begin, end, first_doc, first_begin in words: repeats as the trees give them, overlapping."""
    docs, scratch = _keyed(docs, id_col, text_col), Scratch(docs.sparkSession)
    rows = docs.mapInArrow(lambda it: _anchored(it, least, prefix), "fp long, link long, r long, l long, doc_id long, th long, pos int, upto int")
    same = Window.partitionBy("fp")
    marked = rows.repartition("fp").select("*", F.count("*").over(same).alias("n"), F.count("link").over(same).alias("linked"), F.min("link").over(same).alias("lo"), F.max("link").over(same).alias("hi")).where("n > 1 or upto is not null")
    # a repeat that holds an anchor also holds as many words on its one side or the other as halve the rest of a window
    marked = marked.select("*", F.count("r").over(Window.partitionBy("fp", "r")).alias("rs"), F.count("l").over(Window.partitionBy("fp", "l")).alias("ls")).where("rs > 1 or ls > 1 or upto is not null")
    marked = marked.select("doc_id", "th", F.struct("pos", F.expr(f"linked < n or lo <> hi or pmod(fp, {BREAK}) = 0").alias("begins"), (F.col("n") > hot).alias("hot"), "upto").alias("mark"))
    marks = scratch.save(marked.groupBy("doc_id", "th").agg(F.collect_list("mark").alias("marks")))
    with_marks = docs.join(marks.hint("shuffle_merge"), ["doc_id", "th"])  # marks grow with the corpus: never broadcast
    suffixes = with_marks.mapInArrow(lambda it: _suffixes(it, least, prefix), "key long, doc_id long, th long, pos int, right binary, left binary, more array<int>, upto int, k1 long, k2 long")
    found = suffixes.repartition("key").sortWithinPartitions("key", "right").mapInArrow(lambda it: _repeats(it, least), "doc_id long, th long, begin int, end int, first_doc long, first_begin int, k1 long, k2 long")
    out = scratch.save(found)
    windows = out.where("k1 is not null").select("k1", "k2", "doc_id", "th", "begin")
    if not windows.isEmpty():
        first = scratch.save(windows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
        again = windows.join(small(first, first.count(), 40), ["k1", "k2"]).where(~F.struct("doc_id", "th", "begin").eqNullSafe(F.col("first")))
        all_ = again.select("doc_id", "th", "begin", (F.col("begin") + least).cast("int").alias("end"), F.col("first.doc_id").alias("first_doc"), F.col("first.begin").alias("first_begin"))
        out = scratch.save(out.where("k1 is null").drop("k1", "k2").unionByName(all_))
    scratch.drop_all_but(out)
    return out, scratch


def _merged(found: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document become one."""
    by = Window.partitionBy("doc_id", "th").orderBy("begin", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "th", "island").agg(F.min("begin").alias("start_word"), F.max("end").alias("end_word"), F.min("first_doc").alias("first_doc"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, prefix: int = PREFIX, hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word, first_doc, first_docs: each passage that stands earlier, in words of its document, and the least, and all, of the
    documents where parts of it stand first."""
    found, _ = repeats(docs, id_col, text_col, least, prefix, hot)
    return _merged(found).select("doc_id", "start_word", "end_word", "first_doc", "first_docs")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", least: int = LEAST, prefix: int = PREFIX, hot: int = HOT) -> DataFrame:
    """docs without their repeated passages. chars_col, if docs has it, follows the new text. What is left empty by the cut is dropped."""
    found, scratch = repeats(docs, id_col, text_col, least, prefix, hot)
    spans = scratch.save(_merged(found).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans")))
    scratch.drop(found)
    n, s = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = small(spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), n + s, 32)
    joined = docs.join(spans, (docs[id_col].cast("long") == spans["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == spans["__th"]), "left").drop("__id", "__th")
    names, schema = docs.columns, docs.schema

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans_ = b.column(b.num_columns - 1)
            columns = dict(zip(names, b.columns))
            hit = np.flatnonzero(np.asarray(spans_.is_valid()))
            if len(hit):
                new, keep = columns[text_col].to_pylist(), np.ones(b.num_rows, bool)
                for i in hit.tolist():
                    raw = new[i].encode()
                    buf = np.frombuffer(raw, np.uint8)
                    starts, ends, _ = words(buf, np.array([0, len(buf)]))
                    parts, done = [], 0
                    for x in spans_[i].as_py():  # a cut takes the white space after it along
                        a, z = x["start_word"], x["end_word"]
                        parts.append(raw[done : starts[a]])
                        done = starts[z] if z < len(starts) else len(raw)
                    text = b"".join([*parts, raw[done:]]).decode()
                    keep[i] = bool(text.strip())
                    new[i] = text
                columns[text_col] = pa.array(new, pa.string())
                if chars_col in columns:
                    chars = columns[chars_col].to_pylist()
                    for i in hit.tolist():
                        chars[i] = len(new[i])
                    columns[chars_col] = pa.array(chars, columns[chars_col].type)
                b = pa.RecordBatch.from_arrays(list(columns.values()), names=names).filter(pa.array(keep))
            else:
                b = pa.RecordBatch.from_arrays(list(columns.values()), names=names)
            yield b

    return joined.mapInArrow(cut, schema)
