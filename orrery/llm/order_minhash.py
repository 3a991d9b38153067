"""Order MinHash near-duplicates: sketches that keep the order of sampled k-mers, verified by banded alignment.

Two documents are near-duplicates if the edit similarity of their words, 1 - distance / words of the longer, is at least
`similarity`. Words are compared without ASCII case; white space doesn't count. Groups are the connected components.

Method. Every document gives SKETCHES keys: for each of as many hash functions, the ORDER occurrence-labelled K-word
shingles with the least hashes, in text order. Documents that share a key are candidates. Sketches miss short pairs, so those of at
most SHORT words are found exactly: cut a text of n words into one part more than the edits it may take, and one part stands
unchanged, hardly moved, in the other text. Documents of up to SHORT words give keys for their parts and for the places where those of a longer one may stand. Equal word sequences are one
document from the start. Then, in three rounds:
 1. each bucket's members are aligned with its least member, which settles groups of thousands with one alignment a member;
 2. of each bucket, one member for every group found so far is kept, and all pairs of these not yet tried are aligned;
 3. all pairs of a bucket whose members are still in different groups, and not yet tried, are aligned.
No bucket or partner is capped; after the third round every pair of a bucket has been aligned, or stands in one group without it. Buckets
are rows, never collected: a bucket of more than HOT rows is joined with itself in as many parts as it takes. Pairs are dropped before
their texts are fetched only where no alignment can succeed: by their lengths, or by words that one of them lacks (a bitmap of 256 bits,
each bit that only one has costs an edit).

Defined results: a null, empty or blank text has no words and belongs to no group; rows without an id are left out (and kept
by the filter); rows that are the same in id and text are one document; different texts of one id are documents of their own, told apart by a hash, of which
the filter drops only those that have a near-duplicate; the document with the least id of a group is kept, of several with that id the one
with the least hash; an empty table gives no groups; long texts are sketched and aligned whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD, U, Scratch, hashed_words, keyed, mix, prefix_hashes, small, span_hashes, texts, word_hashes, words

K, ORDER, SKETCHES, SIMILARITY = 3, 3, 64, 0.8
#: Documents of at most so many words find each other without sketches.
SHORT = 32
_rng = np.random.Generator(np.random.PCG64(20))
_XOR = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, 1024, dtype=np.uint64) * U(2) + U(1)
#: Hash values held at once while sketching one document.
CELLS = 1 << 20
#: Rows of a bucket that meet in one part of its join with itself.
HOT = 4096
#: Groups of at most so many pairs are found by the driver (32 MB of them); of more, by joins. Either way gives the same groups.
LOCAL_PAIRS = 2_000_000
BITMAP = ["s0", "s1", "s2", "s3"]


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; of all words where there are fewer."""
    k = min(k, len(w))
    h = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        h = mix(h * U(0xD6E8FEB86659FD93) + w[j : len(w) - k + 1 + j])
    return h


def occurrence_labelled(g: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how many times it came before)."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    out = np.empty(len(s), U)
    out[order] = mix(s + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(U) * U(0x9E3779B97F4A7C15))
    return out


def sketch(w: np.ndarray, k: int = K, order: int = ORDER, sketches: int = SKETCHES) -> np.ndarray:
    """One key for each hash function: the `order` least labelled shingles, in text order."""
    g = shingles(w, k)
    x, n = occurrence_labelled(g), len(g)
    take = min(order, n)
    keys = np.arange(1, sketches + 1).astype(U)
    step = max(1, CELLS // n)
    least = np.empty((sketches, take), np.int64)
    for a in range(0, sketches, step):
        b = min(sketches, a + step)
        h = (x[None, :] ^ _XOR[a:b, None]) * _MUL[a:b, None]
        if n <= 192:
            least[a:b] = np.argpartition(h, take - 1, axis=1)[:, :take] if n > take else np.arange(n)
            continue
        under = h < U(int((1 << 64) * (8.0 * order / n)))
        row, col = np.nonzero(under)
        by = np.lexsort((h[row, col], row))
        row, col = row[by], col[by]
        begin = np.searchsorted(row, np.arange(b - a + 1))
        full = np.diff(begin) >= take
        least[a:b][full] = col[begin[:-1][full][:, None] + np.arange(take)]
        for r in np.flatnonzero(~full):
            least[a + r] = np.argpartition(h[r], take - 1)[:take]
    least.sort(axis=1)
    for j in range(take):
        keys = mix(keys * U(0xD6E8FEB86659FD93) + g[least[:, j]])
    return keys


@functools.cache
def parts(n: int, similarity: float, short: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and salt of each part of n words, and of each run of them that may be a part of a text of n to `short` words."""
    out = set()
    for longer in range(n, short + 1):
        most = int((1 - similarity) * longer + 1e-9)
        if longer - n > most or not most:
            continue
        cuts = [longer * i // (most + 1) for i in range(most + 2)]
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):  # i edits at most before the part, or most - i at most after it
            shift = n - longer
            for at in range(max(a - i, a + shift - (most - i)), min(a + i, a + shift + most - i) + 1):
                if at >= 0 and at + z - a <= n:
                    out.add((at, at + z - a, longer << 8 | i))
    begin, end, salt = np.array(sorted(out), np.int64).reshape(-1, 3).T
    return begin, end, mix(salt.astype(U) + U(0x5851F42D4C957F2D))


def _sketched(batches: Iterator[pa.RecordBatch], k: int, order: int, sketches: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in texts(batches):
        buf = FOLD[buf]
        starts, ends, at = words(buf, off)
        w = word_hashes(buf, starts, ends)
        p, q = prefix_hashes(w), prefix_hashes(w ^ U(0x5DEECE66D))
        n = np.diff(at)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        keys = []
        for i in some:
            own = sketch(w[at[i] : at[i + 1]], k, order, sketches)
            if n[i] <= SHORT:
                begin, end, salt = parts(int(n[i]), similarity)
                own = np.concatenate([own, mix(span_hashes(p, at[i] + begin, at[i] + end) ^ salt)])
            keys.append(own)
        offsets = np.append(0, np.cumsum([len(x) for x in keys])).astype(np.int32)
        keys = np.concatenate(keys).view(np.int64)
        bits = np.zeros((len(n), 256), bool)
        bits[np.repeat(np.arange(len(n)), n), (w >> U(56)).astype(np.int64)] = True
        bitmap = np.packbits(bits[some], axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pa.array(some)), *(pa.array(span_hashes(x, at[some], at[some + 1]).view(np.int64)) for x in (p, q)), pa.array(n[some].astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in bitmap.T), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
            names=["doc_id", "e1", "e2", "n", *BITMAP, "keys"],
        )


def distance_within(x: list, y: list, most: int) -> int | None:
    """Edit distance of two sequences if at most `most`: alignment in the band of so many diagonals to either side.

    A column of the band is one integer for each of the rises, falls and matches (Hyyrö's bit-parallel form), so that a word of y costs
    a dozen operations on integers of 2 * most + 2 bits."""
    n, m = len(x), len(y)
    a = 0
    while a < n and a < m and x[a] == y[a]:
        a += 1
    while n > a and m > a and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    x, y, n, m = x[a:n], y[a:m], n - a, m - a
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    if most >= max(n, m):
        most = max(n, m)
    at: dict = {}
    for i, c in enumerate(x):
        at.setdefault(c, []).append(i)
    masks = {c: sum(1 << i for i in p) for c, p in at.items()}
    if most >= min(n, m):  # the band is the whole table
        full, top = (1 << n) - 1, 1 << (n - 1)
        vp, vn, d = full, 0, n
        for c in y:
            z = masks.get(c, 0)
            d0 = (((z & vp) + vp) ^ vp) | z | vn
            hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
            d += bool(hp & top) - bool(hn & top)
            hp, hn = (hp << 1) | 1, hn << 1
            vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
        return d if d <= most else None
    width = 2 * most + 2
    full, corner = (1 << width) - 1, 1 << (width - 1)
    vp, vn, d = full & ~((1 << (width - most - 1)) - 1), 0, most
    row, shift, give_up = corner >> 1, most + 1 - width, most + m - n + most
    for i, c in enumerate(y):  # the top bit is x[i + most]
        z = masks.get(c, 0)
        z = (z << -shift if shift < 0 else z >> shift) & full
        shift += 1
        d0 = ((((z & vp) + vp) ^ vp) | z | vn) & full
        hp, hn = vn | (full & ~(d0 | vp)), d0 & vp
        if i < n - most:
            d += not d0 & corner
        else:
            d += bool(hp & row) - bool(hn & row)
            row >>= 1
        if d > give_up:
            return None
        half = d0 >> 1
        vp, vn = hn | (full & ~(half | hp)), half & hp
    return d if d <= most else None


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> float | None:
    """The edit similarity of two word sequences, if it is at least `similarity`."""
    longer = max(len(x), len(y))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(x) - len(y)) > most:
        return None
    sx, sy = np.sort(x), np.sort(y)
    at = np.searchsorted(sx, sy)
    if longer - np.count_nonzero(sx[np.minimum(at, len(sx) - 1)] == sy) > most:  # words that lack a partner need an edit each
        return None
    d = distance_within(x.tolist(), y.tolist(), most)
    return None if d is None else 1 - d / longer


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    kept: dict[int, np.ndarray] = {}
    for b in batches:
        out = []
        for i, j, s, t in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text_a"), b.column("text_b")):
            if i not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[i] = hashed_words(s.as_py(), fold=True)
            if (v := similar(kept[i], hashed_words(t.as_py(), fold=True), similarity)) is not None:
                out.append((i, j, v))
        a, c, v = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.float64())], names=["a", "b", "similarity"])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices that have an edge, and the least of each one's component: neighbours' least and that one's least in turn."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(v))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return v, v[root]
        root = new


def components(edges: DataFrame, scratch: Scratch, local: int = LOCAL_PAIRS) -> DataFrame:
    """(v, root): each vertex that has an edge (a, b) and isn't the least of its component, and that one; by large-star and small-star in
    turn where there are more than `local` edges."""
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.count() <= local:
        t = e.toArrow()
        v, root = roots(t.column("u").to_numpy(), t.column("v").to_numpy())
        other = v != root
        out = scratch.save(e.sparkSession.createDataFrame(pa.table({"v": v[other], "root": root[other]}), "v long, root long"))
        scratch.drop(e)
        return out
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", near.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = F.min("v").over(Window.partitionBy("u"))
        lifted = large.where("u <> v").distinct().select("u", "v", low.alias("m"))
        new = lifted.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lifted.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e2 = scratch.save(new)
        now = e2.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(e)
        e = e2
        if tuple(now) == state:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        state = tuple(now)


def _units(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with another number in place of an id that stands with several texts; and (v, doc_id, th) of those numbers, if any."""
    docs = keyed(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    several = scratch.save(docs.groupBy("doc_id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo <> hi").select("doc_id", F.lit(True).alias("several")))
    if not (n := several.count()):
        return docs.drop("th"), None
    docs = docs.join(small(several, n, 16), "doc_id", "left").withColumn("v", F.when(F.col("several"), F.xxhash64("doc_id", "th")).otherwise(F.col("doc_id")))
    return docs.select(F.col("v").alias("doc_id"), "text"), scratch.save(docs.where("several").select("v", "doc_id", "th").distinct())


def _groups(docs: DataFrame, id_col: str, text_col: str, similarity: float, k: int, order: int, sketches: int, hot: int, local: int) -> DataFrame:
    """doc_id, th, duplicate_of: every document that isn't the first of its group, and the least id of the group. th is null where the id has one text."""
    scratch = Scratch(docs.sparkSession)
    docs, numbers = _units(docs, id_col, text_col, scratch)
    sketched = scratch.save(docs.mapInArrow(lambda it: _sketched(it, k, order, sketches, similarity), f"doc_id long, e1 long, e2 long, n int, {', '.join(f'{s} long' for s in BITMAP)}, keys array<long>"))
    first = F.min("doc_id").over(Window.partitionBy("e1", "e2"))
    equal = scratch.save(sketched.select("doc_id", first.alias("rep")).where("doc_id <> rep").distinct())
    n_equal = equal.count()
    # each word sequence is represented by its least id
    firsts = sketched.select("doc_id", "n", "keys").join(small(equal.select("doc_id").distinct(), n_equal, 8), "doc_id", "left_anti")
    of_key = Window.partitionBy("key")
    bucket = firsts.select("doc_id", "n", F.explode("keys").alias("key")).select("key", "doc_id", "n", F.min(F.struct("doc_id", "n")).over(of_key).alias("first"), F.max("doc_id").over(of_key).alias("last"))
    inside = scratch.save(bucket.where("first.doc_id <> last").drop("last"))
    ids = scratch.save(inside.select("doc_id").distinct())
    few = small(ids, ids.count(), 8)
    texts_ = scratch.save(docs.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    bitmaps = scratch.save(sketched.select("doc_id", "n", *BITMAP).join(few, "doc_id", "left_semi").distinct())
    bitmaps = small(bitmaps, ids.count(), 52)

    def alike(x: str, y: str) -> Column:
        """Whether documents of these lengths may be similar."""
        return F.least(f"{x}.n", f"{y}.n") >= F.ceil(F.greatest(f"{x}.n", f"{y}.n") * (similarity - 1e-9))

    def shared(x: str, y: str) -> Column:
        """Whether they lack no more words of each other than edits are allowed."""
        lacks = lambda p, q: sum((F.bit_count(F.col(f"{p}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{q}.{s}")))) for s in BITMAP), F.lit(0))
        return F.greatest(lacks(x, y), lacks(y, x)) <= F.floor(F.greatest(f"{x}.n", f"{y}.n") * (1 - similarity) + 1e-9)

    def verify(pairs: DataFrame) -> DataFrame:
        b = pairs.join(texts_.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
        both = b.join(texts_.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")
        return scratch.save(both.mapInArrow(lambda it: _verified(it, similarity), "a long, b long, similarity double"))

    def met(rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of a bucket's members (key, root, doc_id) in different groups."""
        rows = rows.select("key", "root", "doc_id", F.min("root").over(of_key).alias("lo"), F.max("root").over(of_key).alias("hi"), F.ceil(F.count("*").over(of_key) / hot).cast("int").alias("parts"))
        rows = scratch.save(rows.where("lo <> hi").drop("lo", "hi").join(bitmaps, "doc_id"))
        x, y = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")), rows.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        pairs = x.alias("x").join(y.alias("y"), F.expr("x.key = y.key and x.part = y.part and x.root < y.root")).where(alike("x", "y") & shared("x", "y"))
        return pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()

    def rooted(edges: DataFrame, n: int) -> DataFrame:
        groups = components(edges, scratch, local).withColumnRenamed("v", "doc_id")
        return inside.select("key", "doc_id").join(small(groups, n, 16), "doc_id", "left").select("key", F.coalesce("root", "doc_id").alias("root"), "doc_id")

    stars = inside.where("doc_id <> first.doc_id").select(F.struct("doc_id", "n").alias("m"), "first").where(alike("m", "first")).select(F.col("first.doc_id").alias("a"), F.col("m.doc_id").alias("b")).distinct()
    stars = stars.join(bitmaps.select(F.col("doc_id").alias("a"), F.struct("n", *BITMAP).alias("x")), "a").join(bitmaps.select(F.col("doc_id").alias("b"), F.struct("n", *BITMAP).alias("y")), "b")
    stars = scratch.save(stars.where(shared("x", "y")).select("a", "b"))
    found = verify(stars)
    tried = scratch.save(met(rooted(found, found.count()).groupBy("key", "root").agg(F.min("doc_id").alias("doc_id"))).join(stars, ["a", "b"], "left_anti"))
    old = scratch.save(found.select("a", "b").unionByName(verify(tried).select("a", "b")))
    # pairs inside a group are never listed: a bucket's members meet by group
    last = verify(met(rooted(old, 2 * old.count())).join(stars.unionByName(tried), ["a", "b"], "left_anti"))
    edges = old.unionByName(last.select("a", "b")).unionByName(equal.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    groups = components(edges, scratch, local)
    if numbers is None:
        out = groups.select(F.col("v").alias("doc_id"), F.lit(None).cast("long").alias("th"), F.col("root").alias("duplicate_of"))
    else:  # the least of a group is found among the documents, not their numbers
        all_ = groups.unionByName(groups.select(F.col("root").alias("v"), "root").distinct()).join(numbers, "v", "left")
        named = all_.select("root", F.struct(F.coalesce("doc_id", "v").alias("doc_id"), "th").alias("d")).withColumn("least", F.min("d").over(Window.partitionBy("root")))
        out = named.where(~F.col("d").eqNullSafe(F.col("least"))).select("d.doc_id", "d.th", F.col("least.doc_id").alias("duplicate_of"))
    out = scratch.save(out)
    scratch.drop_all_but(out)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = K, order: int = ORDER, sketches: int = SKETCHES, hot: int = HOT, local: int = LOCAL_PAIRS) -> DataFrame:
    """doc_id, duplicate_of: every document that has a near-duplicate with a lesser id, and the least id of its group."""
    out = _groups(docs, id_col, text_col, similarity, k, order, sketches, hot, local)
    return out.where("doc_id <> duplicate_of").select("doc_id", "duplicate_of").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, k: int = K, order: int = ORDER, sketches: int = SKETCHES, hot: int = HOT, local: int = LOCAL_PAIRS) -> DataFrame:
    """docs without those rows whose document isn't the first of its group; columns as they were."""
    gone = _groups(docs, id_col, text_col, similarity, k, order, sketches, hot, local).select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th"))
    same = (docs[id_col].cast("long") == gone["__gone"]) & (gone["__th"].isNull() | (gone["__th"] == F.xxhash64(docs[text_col].cast("string"))))
    return docs.join(small(gone, gone.count(), 16), same, "left_anti")
