"""Interpolated modified Kneser-Ney language model over words (order 3): every n-gram of the corpus counted in Spark, none pruned,
stored as sorted hash arrays by range, memory-mapped for perplexity.

The model predicts each word of a text from the two before it; a text begins after two words BEGIN. Words are runs of bytes
above 0x20, as they stand. A word is its 48-bit hash, an n-gram a 64-bit hash of its words' hashes, so tables grow with the corpus:

    p_k(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + gamma(h) p_{k-1}(w | h'),  p_0 = 1 / (distinct words + 1)
    gamma(h) = (D1 N1(h) + D2 N2(h) + D3 N3+(h)) / c(h),  p_k(w | h) = p_{k-1}(w | h') where h is unknown

Lower orders count distinct left neighbours; the discounts come from the counts of counts of each order. The tables are made in one
job of two exchanges of compressed blocks, each block the rows of one range:
 1. trigrams (a, b, c) by range of the middle word b: a range then holds all of a trigram, all that follows the context (a, b), and all that
    stands before the bigram (b, c). Words that would outgrow a range are found first and parted by c as well. A block has a dictionary of its
    words, sorted, and the trigrams as numbers of it, sorted;
 2. words, as contexts and with how many words stand before them, by range of the word; and contexts (a, b) whose b is parted, by range of the
    context, where what follows them is summed over the parts. So each n-gram is looked for in one table, however many parts there are.
There are as many ranges as RANGE_BYTES go into the text, so that what a task holds doesn't grow. Each range is one file for each table in the
shared folder; only the list of files goes through the driver. A file of a lost or repeated task isn't in the list.

A table is the sorted hashes, in buckets of about 16 by their first bits and with the next 24 bits of each, and a byte for each that
stands for its values: the 255 commonest are listed, others lie apart in full. An n-gram that the corpus lacks is taken for one that it has
once in a million times (16 / 2**24). Texts are scored in slices that grow with the number of ranges, and each table that a slice needs is searched
once, for all different n-grams that the slice has there.

Defined results: null, empty and blank texts count nothing and have a null perplexity; rows without an id are counted and scored like others;
rows that repeat count as often as they occur; a corpus without words gives every word p = 1; an empty table gives an empty
table; long texts are read whole.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, U, mix, texts, word_hashes, words

WORD_BITS = 48
BEGIN = U(0x6A09E667F3BC)
#: Bytes of text hashed at a time, counted at a time, and of a range of hashes.
SLICE, PIECE, RANGE_BYTES = 2 << 20, 16 << 20, 16 << 20
#: Bytes of text scored at a time: so many for each range, since a search costs some 70 calls to numpy in each table, and at most so many in all.
SCORED, MOST_SCORED = 4 << 10, 6 << 20
#: Bytes of text for each occurrence from which on a word is too frequent for one range.
HEAVY = 24
#: Tasks that sum words and contexts, one range after another: each more would fetch from every range's task once more.
SUMMED = 256
#: Bytes of tables that a worker keeps where the shared folder can't be mapped.
KEPT = 256 << 20
TRIGRAMS, CONTEXTS, BIGRAMS, WORDS = range(4)
_COLUMNS = {TRIGRAMS: 1, CONTEXTS: 4, BIGRAMS: 1, WORDS: 5}
_SCHEMA = "range int, kind int, n long, over long, file string, n1 long, n2 long, n3 long, n4 long, total long, before long, block binary"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary())
_cache: dict = {}
_compress, _decompress = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams occur once, twice, ...; the usual middle values where one of these is missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.0), float(i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def joined(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of what x is the key of, and the word w after it."""
    return mix(mix(x) * U(0xD6E8FEB86659FD93) + w)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word, the one before it and the one before that; and where each text's begin."""
    starts, ends, at = words(buf, off)
    n = len(at) - 1
    padded = np.full(len(starts) + 2 * n, BEGIN, U)
    place = np.arange(len(starts)) + np.repeat(2 * np.arange(1, n + 1), np.diff(at))
    padded[place] = word_hashes(buf, starts, ends) >> U(64 - WORD_BITS)
    return padded[place - 2], padded[place - 1], padded[place], at


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys in order, a place of each, and the sums of its values."""
    by = np.argsort(keys)
    k = keys[by]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], by[first], [np.add.reduceat(v[by], first) for v in values]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, a place of each, and how often it is there."""
    by = np.argsort(keys)
    k = keys[by]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], by[first], np.diff(np.append(first, len(k)))


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of 64."""
    return (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


class Ranges:
    """Which range a trigram belongs to, by its middle word, and by its last one where the middle word is heavy."""

    def __init__(self, bits: int, heavy: dict[int, int]) -> None:
        self.bits, self.word_bits = bits, max(0, bits - 2)  # words are fewer than trigrams
        self.words = np.array(sorted(heavy), U)
        self.parts = np.array([heavy[w] for w in sorted(heavy)], np.int64)  # bits of parts

    def heavy(self, b: np.ndarray) -> np.ndarray:
        """Which of the heavy words each is; -1 for none."""
        if not len(self.words):
            return np.full(len(b), -1)
        at = np.minimum(np.searchsorted(self.words, b), len(self.words) - 1)
        return np.where(self.words[at] == b, at, -1)

    def of_part(self, b: np.ndarray, part: np.ndarray) -> np.ndarray:
        return _top(mix(mix(b) + part.astype(U) * U(0xD6E8FEB86659FD93)), self.bits)

    def of(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        part, which = np.zeros(len(b), np.int64), self.heavy(b)
        some = np.flatnonzero(which >= 0)
        part[some] = (mix(c[some]) >> (U(64) - self.parts[which[some]].astype(U))).astype(np.int64)
        return self.of_part(b, part)

    def of_context(self, key: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The range of the trigrams that the context begins; where b is heavy one of as many more, by the context's key."""
        return np.where(self.heavy(b) < 0, self.of_part(b, np.zeros(len(b), np.int64)), (1 << self.bits) + _top(mix(key), self.bits))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(_TYPES), _TYPES)], names=[f.split()[0] for f in _SCHEMA.split(", ")])


def _planes(x: np.ndarray, width: int) -> bytes:
    """The numbers' first bytes, then their second ones, ...: those of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def _packed(columns: list[np.ndarray]) -> bytes:
    """Lengths, widths and compressed planes of several columns."""
    out = []
    for x in columns:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        data = _compress(_planes(x, width))
        out += [np.array([len(x), width, len(data)], np.int64).tobytes(), data]
    return b"".join(out)


def _unpacked(block: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(block):
        n, width, size = np.frombuffer(block, np.int64, 3, at).tolist()
        out.append(_unplanes(_decompress(block[at + 24 : at + 24 + size]), n, width))
        at += 24 + size
    return out


def trigram_block(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct trigrams and their counts: a sorted dictionary, and for each bigram (b, c) the words before it."""
    known, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    m = len(a)
    x, y, z = at[:m], at[m : 2 * m], at[2 * m :]
    by = np.argsort((y << 42) | (z << 21) | x) if len(known) < 1 << 21 else np.lexsort((x, z, y))
    x, y, z = x[by], y[by], z[by]
    first = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (z[1:] != z[:-1])))
    return _packed([np.diff(known, prepend=U(0)), x, np.diff(y[first], prepend=0), z[first], np.diff(np.append(first, m)), n[by]])


def trigrams_of(block: bytes) -> list[np.ndarray]:
    known, x, y, z, sizes, n = _unpacked(block)
    known = np.cumsum(known, dtype=U)
    sizes = sizes.astype(np.int64)
    return [known[x], np.repeat(known[np.cumsum(y, dtype=U)], sizes), np.repeat(known[z], sizes), n]


def _blocks(ranges: np.ndarray, columns: list[np.ndarray], pack) -> Iterator[pa.RecordBatch]:
    """The columns parted by range, each part packed."""
    by = np.argsort(ranges, kind="stable")
    r = ranges[by]
    begin = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
    columns, rows = [c[by] for c in columns], []
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(r)]):
        rows.append((int(r[i]), -1, j - i, 0, None, 0, 0, 0, 0, 0, 0, pack(*(c[i:j] for c in columns))))
        if len(rows) == 64 or j == len(r):
            yield _rows(rows)
            rows = []


def _of_ranges(batches: Iterator[pa.RecordBatch], unpack) -> Iterator[tuple[int, list[np.ndarray] | pa.RecordBatch]]:
    """The blocks of each range, joined; rows sorted by range. Reports of files come through as they are, as range -1."""
    now, parts = None, []
    for b in batches:
        kinds = np.asarray(b.column("kind"))
        if (kinds >= 0).any():
            yield -1, b.filter(pa.array(kinds >= 0))
        for i in np.flatnonzero(kinds < 0).tolist():
            r = b.column("range")[i].as_py()
            if r != now and parts:
                yield now, _joined_columns(parts)
            now = r
            parts.append(unpack(b.column("block")[i].as_py()))
    if parts:
        yield now, _joined_columns(parts)


def _joined_columns(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The parts' columns, each joined; the parts go as they are joined."""
    out = []
    for k in range(len(parts[0])):
        out.append(np.concatenate([p[k] for p in parts]))
        for p in parts:
            p[k] = None
    parts.clear()
    return out


class Table:
    """Sorted hashes and the values of each, in one buffer."""

    @staticmethod
    def parts(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
        """The arrays of a table: head, listed values, places and values of the others, buckets, hashes, and a byte for each; keys rise."""
        values = np.stack(columns, axis=1).astype(np.int64)
        bits = max(0, (len(keys) // 16).bit_length())
        bounds = np.append(np.searchsorted(_top(keys, bits), np.arange(1 << bits)), len(keys)).astype(np.uint32)
        low = ((keys << U(bits)) >> U(40)).astype(np.uint32)
        packed = sum((values[:, k].astype(U) << U(12 * k) for k in range(values.shape[1])), np.zeros(len(keys), U))
        narrow = (values < 1 << 12).all(axis=1)
        common, first, times = np.unique(packed[narrow], return_index=True, return_counts=True)
        top = np.argsort(-times, kind="stable")[:255]
        listed = values[narrow][first[top]]
        code = np.full(len(keys), 255, np.uint8)
        order = np.argsort(common[top])
        if len(top):
            at = np.minimum(np.searchsorted(common[top][order], packed), len(top) - 1)
            hit = narrow & (common[top][order][at] == packed)
            code[hit] = order[at[hit]]
        other = np.flatnonzero(code == 255)
        head = np.array([len(keys), bits, len(listed), len(other), values.shape[1], 0, 0, 0], np.int64)
        wide = np.int64 if len(other) and values[other].max() >> 32 else np.uint32
        head[5] = np.dtype(wide).itemsize
        return [head, listed, values[other].astype(wide), other.astype(np.uint32), bounds, (low >> 8).astype(np.uint16), low.astype(np.uint8), code]

    def __init__(self, data) -> None:
        self.n, self.bits, listed, others, self.columns, wide = np.frombuffer(data, np.int64, 6).tolist()
        at = 64

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.listed = take(np.int64, listed * self.columns).reshape(-1, self.columns)
        self.values = take(np.int64 if wide == 8 else np.uint32, others * self.columns).reshape(-1, self.columns)
        self.other, self.bounds = take(np.uint32, others), take(np.uint32, (1 << self.bits) + 1)
        self.high, self.low, self.code = take(np.uint16, self.n), take(np.uint8, self.n), take(np.uint8, self.n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values, a row each."""
        return found([(0, len(keys), self)], keys, self.columns)


def found(tables: list[tuple[int, int, Table]], keys: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are there, and their values, a row each, of keys i to j in the table given with i and j.

    All tables are searched in step: what is done for each is to take from its arrays, so that many tables cost little more than one."""

    def taken(name: str, at: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(len(keys), kind)
        for i, j, t in tables:
            getattr(t, name).take(at[i:j], out=out[i:j], mode="clip")
        return out

    def tags(at: np.ndarray) -> np.ndarray:
        return taken("high", at, np.uint16).astype(np.uint32) << np.uint32(8) | taken("low", at, np.uint8)

    bits, last = np.zeros(len(keys), U), np.full(len(keys), -1)
    for i, j, t in tables:
        bits[i:j], last[i:j] = t.bits, t.n - 1
    bucket = ((keys >> U(1)) >> (U(63) - bits)).astype(np.int64)
    want = ((keys << bits) >> U(40)).astype(np.uint32)
    lo, end = taken("bounds", bucket, np.uint32).astype(np.int64), taken("bounds", bucket + 1, np.uint32).astype(np.int64)
    hi = end.copy()
    for _ in range(int((end - lo).max()).bit_length() if len(keys) else 0):
        mid = np.minimum((lo + hi) >> 1, last)
        less = (lo < hi) & (tags(mid) < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(hi, mid))
    at = np.minimum(lo, last)
    hit = np.flatnonzero((lo < end) & (tags(at) == want))
    at, out = at[hit], np.zeros((len(hit), columns), np.int64)
    for (_, _, t), i, j in zip(tables, np.searchsorted(hit, [i for i, _, _ in tables]).tolist(), np.searchsorted(hit, [j for _, j, _ in tables]).tolist()):
        if i < j:
            code = t.code.take(at[i:j])
            if len(t.listed):
                t.listed.take(code, axis=0, out=out[i:j], mode="clip")
            if len(t.other) and len(far := np.flatnonzero(code == 255)):
                out[i + far] = t.values[np.searchsorted(t.other, at[i + far])]
    return hit, out


def _file(path: str, kind: int, r: int, keys: np.ndarray, columns: list[np.ndarray], own: np.ndarray | None) -> tuple:
    """Writes a table; the report of it."""
    parts = Table.parts(keys, columns)
    system, folder = fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)
    name = f"{folder}/{kind}-{r}-{uuid.uuid4().hex}"
    with system.open_output_stream(name) as f:
        for x in parts:
            f.write(np.ascontiguousarray(x).tobytes())
    counts = [int(np.count_nonzero(own == i)) for i in (1, 2, 3, 4)] if own is not None else [0] * 4
    return (-1, kind, len(keys), len(parts[3]), f"{r}:{name}", *counts, *((int(own.sum()), int(np.count_nonzero(own)) * (kind == WORDS)) if own is not None else (0, 0)), None)


def _following(context: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each context: a place of it, what follows it in all, and how many words follow it once, twice and more often."""
    return summed(context, c, *((f(c)).astype(np.int64) for f in (lambda x: x == 1, lambda x: x == 2, lambda x: x > 2)))


def _sums_block(w: np.ndarray, *x: np.ndarray) -> bytes:
    return _packed([np.diff(w, prepend=U(0)), *x])


def _sums_of(block: bytes) -> list[np.ndarray]:
    w, *x = _unpacked(block)
    return [np.cumsum(w, dtype=U), *(y.astype(np.int64) for y in x)]


def _heavy(batches: Iterator[pa.RecordBatch], total: int, range_bytes: int) -> Iterator[pa.RecordBatch]:
    """word, n: how often words that may be heavy occur; a word that isn't among them in any piece is in none too often."""
    for _, buf, off in texts(batches, size=SLICE):
        w, n = np.unique(tokens(buf, off)[2], return_counts=True)
        some = n * total >= range_bytes // HEAVY * len(buf)
        yield pa.RecordBatch.from_arrays([pa.array(w[some].view(np.int64)), pa.array(n[some])], names=["word", "n"])


def _counted(batches: Iterator[pa.RecordBatch], ranges: Ranges) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0

    def blocks() -> Iterator[pa.RecordBatch]:
        a, b, c = (np.concatenate([x[i] for x in parts]) for i in range(3))
        parts.clear()
        _, at, n = counted(joined(joined(a, b), c))
        a, b, c = a[at], b[at], c[at]
        yield from _blocks(ranges.of(b, c), [a, b, c, n], trigram_block)

    for _, buf, off in texts(batches, size=SLICE):
        *abc, _ = tokens(buf, off)
        if len(abc[2]):
            parts.append(abc)
        size += len(buf)
        if size >= PIECE and parts:
            yield from blocks()
            size = 0
    if parts:
        yield from blocks()


def _trigrams(batches: Iterator[pa.RecordBatch], ranges: Ranges, path: str) -> Iterator[pa.RecordBatch]:
    for r, (a, b, c, n) in _of_ranges(batches, trigrams_of):
        keys, at, (n,) = summed(joined(joined(a, b), c), n.astype(np.int64))
        a, b, c = a[at], b[at], c[at]
        yield _rows([_file(path, TRIGRAMS, r, keys, [n], n)])
        keys, at, follow = _following(joined(a, b), n)
        which = ranges.heavy(b[at])
        if (whole := which < 0).any():
            yield _rows([_file(path, CONTEXTS, r, keys[whole], [x[whole] for x in follow], None)])
        by = np.flatnonzero(~whole)
        by = by[np.lexsort((a[at[by]], which[by]))]
        yield from _blocks(ranges.of_context(keys[by], b[at[by]]), [a[at[by]], which[by], *(x[by] for x in follow)], _sums_block)
        del a, keys, at, follow, which, whole, by
        keys, at, n = counted(joined(b, c))
        yield _rows([_file(path, BIGRAMS, r, keys, [n], n)])
        context, _, follow = _following(b[at], n)
        word, _, before = counted(c[at])
        none = [np.zeros(len(word), np.int64)] * 4
        word, _, sums = summed(np.concatenate([context, word]), *(np.concatenate(x) for x in zip([*follow, np.zeros(len(context), np.int64)], [*none, before])))
        del b, c, keys, at, n
        yield from _blocks(_top(word << U(64 - WORD_BITS), ranges.word_bits), [word, *sums], _sums_block)


def _words(batches: Iterator[pa.RecordBatch], ranges: Ranges, path: str) -> Iterator[pa.RecordBatch]:
    """Tables of words, and of the contexts of heavy words."""
    for r, rows in _of_ranges(batches, _sums_of):
        if r < 0:
            yield rows
        elif r < 1 << ranges.bits:
            keys, _, sums = summed(*rows)
            yield _rows([_file(path, WORDS, r, keys << U(64 - WORD_BITS + ranges.word_bits), sums, sums[4])])
        else:
            a, which, *follow = rows
            keys, _, sums = summed(joined(a, ranges.words[which]), *follow)
            yield _rows([_file(path, CONTEXTS, r, keys, sums, None)])


class WordModel:
    """The tables of a model, mapped when they are first needed."""

    def __init__(self, ranges: Ranges, path: str, reports: list) -> None:
        self.ranges, self.path, self.files, count = ranges, path, {}, np.zeros((4, 5), np.int64)
        self.n_words = sum(x.before for x in reports)
        for x in reports:
            r, _, name = x.file.partition(":")
            self.files[x.kind, int(r)] = (name, x.n, x.over)
            count[x.kind] += (x.n1, x.n2, x.n3, x.n4, x.total)
        self.discounts = {k: np.array([0.0, *discounts(*count[kind][:4].tolist())]) for k, kind in ((1, WORDS), (2, BIGRAMS), (3, TRIGRAMS))}
        self.first = count[WORDS].tolist()

    def table(self, kind: int, r: int) -> Table | None:
        """The table of a range. In a mounted folder its pages are shared by all workers of a machine; elsewhere a worker reads a
        range when it is needed and keeps some."""
        if (kind, r) not in self.files:
            return None
        name = self.files[kind, r][0]
        if name not in _cache:
            system, _ = fs.FileSystem.from_uri(self.path)
            if isinstance(system, fs.LocalFileSystem):
                with open(name, "rb") as f:
                    _cache[name] = Table(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)), 0
            else:
                with system.open_input_file(name) as f:
                    data = f.read()
                while sum(size for _, size in _cache.values()) + len(data) > KEPT and any(size for _, size in _cache.values()):
                    del _cache[next(k for k, (_, size) in _cache.items() if size)]
                _cache[name] = Table(data), len(data)
        return _cache[name][0]

    def find(self, kind: int, keys: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The values of each key, in its range; zero where there are none. What is there again and again is looked for once."""
        bits = U(self.ranges.bits + 1)
        order = np.argsort((r.astype(U) << (U(64) - bits)) | (keys >> bits))
        r, keys = r[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (r[1:] != r[:-1])
        r, keys = r[new], keys[new]
        values = np.zeros((_COLUMNS[kind], len(keys)), np.int64)
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
        tables = [(i, j, table) for i, j, at in zip(begin.tolist(), [*begin[1:].tolist(), len(r)], r[begin].tolist()) if (table := self.table(kind, at)) is not None]
        hit, some = found(tables, keys, _COLUMNS[kind])
        values[:, hit] = some.T
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return values[:, back]

    def probabilities(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of each word c after a and b."""

        def words(w: np.ndarray) -> np.ndarray:
            top, bits = w << U(64 - WORD_BITS), self.ranges.word_bits
            return self.find(WORDS, top << U(bits), _top(top, bits))

        def level(k: int, n: np.ndarray, total: np.ndarray, n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, lower: np.ndarray) -> np.ndarray:
            d, whole = self.discounts[k], np.maximum(total, 1)
            return np.where(total > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / whole + (d[1] * n1 + d[2] * n2 + d[3] * n3) / whole * lower, lower)

        n1, n2, _, _, total = self.first
        r = self.ranges.of(b, c)
        p = level(1, words(c)[4], *(np.int64(x) for x in (total, n1, n2, self.n_words - n1 - n2)), 1 / (self.n_words + 1))
        p = level(2, self.find(BIGRAMS, joined(b, c), r)[0], *words(b)[:4], p)
        ab = joined(a, b)
        return level(3, self.find(TRIGRAMS, joined(ab, c), r)[0], *self.find(CONTEXTS, ab, self.ranges.of_context(ab, b)), p)

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of each text, and the sum of their log2 probabilities."""
        a, b, c, at = tokens(buf, off)
        sums = np.zeros(len(c) + 1)
        if len(c):
            np.cumsum(np.log2(self.probabilities(a, b, c)), out=sums[1:])
        return np.diff(at), sums[at[1:]] - sums[at[:-1]]


def build_words(docs: DataFrame, text_col: str = "text", range_bytes: int = RANGE_BYTES) -> WordModel:
    """The model of all texts of docs."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, -(-size // range_bytes) - 1).bit_length()
    path, heavy = Scratch(docs.sparkSession).path(), {}
    if bits:
        most = range_bytes // HEAVY
        counts = rows.mapInArrow(lambda it: _heavy(it, size, range_bytes), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > most)
        heavy = {r.word: min(bits, (-(-r.n // most) - 1).bit_length()) for r in counts.collect()}
    ranges = Ranges(bits, heavy)

    def met(df: DataFrame, tasks: int) -> DataFrame:
        return df.repartition(tasks, "range").sortWithinPartitions("range")

    table = met(rows.mapInArrow(lambda it: _counted(it, ranges), _SCHEMA), 1 << bits)
    table = met(table.mapInArrow(lambda it: _trigrams(it, ranges, path), _SCHEMA), min(1 << bits, SUMMED))
    reports = table.mapInArrow(lambda it: _words(it, ranges, path), _SCHEMA).drop("block").collect()
    return WordModel(ranges, path, reports)


def word_perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: WordModel | None = None) -> DataFrame:
    """doc_id, n_words, log2_probability, perplexity (a word) for each row of docs, by the model of docs themselves unless another is given."""
    model = model or build_words(docs, text_col)
    size = max(SLICE, min(SCORED << model.ranges.bits, MOST_SCORED))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in texts(it, size=size):
            n, s = model.score(buf, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(s, mask=n == 0), pa.array(2 ** (-s / np.maximum(n, 1)), mask=n == 0)], names=["doc_id", "n_words", "log2_probability", "perplexity"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, n_words long, log2_probability double, perplexity double")
