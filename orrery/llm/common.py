"""What the text operators share: vectorised words and hashes over Arrow batches, and tables in the shared folder.

A word is a longest run of bytes above 0x20. Text columns may hold nulls; they count as empty. Ids are integers, or what Spark casts to
them without an error; a table with other ids is numbered first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, new_path

U = np.uint64
#: Bytes of text handled at a time; arrays of eight bytes a letter then stay in the processor's cache.
CHUNK = 1 << 20
#: A side of a join is broadcast only if it is known to take at most so many bytes; beyond that the join shuffles.
BROADCAST_BYTES = 32 << 20
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
#: ASCII upper case to lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def powers(base: U, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def texts(batches: Iterator[pa.RecordBatch], size: int = CHUNK, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, with their texts' bytes and where each text begins; a text is never split."""
    for b in batches:
        t = pc.fill_null(b.column(name).cast(pa.large_string()), "")
        n = len(t)
        if not n:
            continue
        _, offsets, data = t.buffers()
        off = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * t.offset)
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield b.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of the first word of each text."""
    inside = buf > 32
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside
    first[1:] &= edge[1:-1] | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= edge[1:-1] | ~inside[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def prefix_hashes(values: np.ndarray, base: U = BASE) -> np.ndarray:
    """Sums from which span_hashes() has the hash of any span."""
    p = np.zeros(len(values) + 1, U)
    p[1:] = values
    p[1:] += U(1)
    p[1:] *= powers(base, len(values))
    np.cumsum(p[1:], out=p[1:])
    return p


def span_hashes(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: U = BASE_INV) -> np.ndarray:
    """A hash of the values from start to end, the same wherever they stand."""
    return mix((p[ends] - p[starts]) * powers(inverse, len(p))[starts])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(buf), starts, ends)


def hashed_words(text: bytes | str, fold: bool = False) -> np.ndarray:
    """The hashes of one text's words."""
    buf = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
    if fold:
        buf = FOLD[buf]
    s, e, _ = words(buf, np.array([0, len(buf)]))
    return word_hashes(buf, s, e)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors. What drop() doesn't remove goes when the session's Python ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def path(self) -> str:
        return new_path(self.spark)

    def save(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._orrery_scratch = self  # keeps id() unique as long as the table is known
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete(self.spark, self.paths.pop(id(df)))

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Removes all tables saved so far, but those given."""
        kept = {id(df) for df in tables}
        for k in [k for k in self.paths if k not in kept]:
            delete(self.spark, self.paths.pop(k))


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks df for broadcast if so many rows of so many bytes are few enough, else leaves the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, under fixed names, so that other columns can't clash. Rows without an id are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
