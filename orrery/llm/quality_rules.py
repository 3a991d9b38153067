"""Compression bands: zstandard ratios of whole documents and of fixed chunks find repetitive and incompressible text.

The ratio is compressed over plain bytes. Short texts compress worse, so the limits depend on the length. A document is
rejected if its own ratio lies outside its band, or if more than CHUNK_SHARE of its chunks lie outside theirs.

Defined results: a null or blank text, and any shorter than the first band, has no band to leave and is kept; a null id is
kept as it is; rows that repeat are judged alike; an empty table gives an empty table; other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From so many bytes on: least and greatest ratio.
BANDS = ((128, 0.35, 1.20), (256, 0.33, 1.00), (512, 0.30, 0.90), (1024, 0.27, 0.82), (2048, 0.25, 0.78), (4096, 0.22, 0.75), (16384, 0.20, 0.72))
#: The same, the greatest between clean text and base64 of random bytes; op5_quality_rules and the pipeline use these.
TIGHT_BANDS = ((128, 0.35, 0.94), (192, 0.35, 0.88), (256, 0.33, 0.79), (512, 0.30, 0.75), (1024, 0.27, 0.70), (2048, 0.25, 0.65), (4096, 0.22, 0.75), (16384, 0.20, 0.72))
CHUNK_BYTES = 4096
#: A rest of fewer bytes belongs to the chunk before it.
LEAST_CHUNK = 1024
CHUNK_SHARE = 0.25
LEVEL = 3
SCHEMA = "ratio double, n_bytes long, chunks int, repetitive_chunks int, incompressible_chunks int"


def band(n: int, bands=BANDS) -> tuple[float, float]:
    lo, hi = 0.0, float("inf")
    for least, low, high in bands:
        if n >= least:
            lo, hi = low, high
    return lo, hi


def measure(text: bytes, compress, bands=BANDS, chunk_bytes: int = CHUNK_BYTES) -> tuple:
    """Ratio, bytes, chunks, and how many of these are too repetitive or too incompressible."""
    n = len(text)
    if not n:
        return None, 0, 0, 0, 0
    ratio = len(compress(text)) / n
    if n < chunk_bytes + LEAST_CHUNK:
        return ratio, n, 1, int(ratio < band(n, bands)[0]), int(ratio > band(n, bands)[1])
    cuts = [*range(0, n, chunk_bytes), n]
    if cuts[-1] - cuts[-2] < LEAST_CHUNK:
        del cuts[-2]
    view, low, high = memoryview(text), 0, 0
    for a, b in zip(cuts, cuts[1:]):
        r, (lo, hi) = len(compress(view[a:b])) / (b - a), band(b - a, bands)
        low += r < lo
        high += r > hi
    return ratio, n, len(cuts) - 1, low, high


def _batch(batches: Iterator[pa.RecordBatch], bands, chunk_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=level, write_checksum=False).compress
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.large_binary())
        rows = [measure((t.as_buffer().to_pybytes() if t.is_valid else b""), compress, bands, chunk_bytes) for t in texts]
        ratio, n, chunks, low, high = zip(*rows) if rows else ((),) * 5
        limits = [band(x, bands) for x in n]
        repetitive = [r is not None and (r < lo or a > CHUNK_SHARE * c) for r, (lo, _), a, c in zip(ratio, limits, low, chunks)]
        incompressible = [r is not None and (r > hi or a > CHUNK_SHARE * c) for r, (_, hi), a, c in zip(ratio, limits, high, chunks)]
        mixed = [not p and not q and a + z > CHUNK_SHARE * c for p, q, a, z, c in zip(repetitive, incompressible, low, high, chunks)]
        reason = ["repetitive" if p else "incompressible" if q else "mixed" if m else None for p, q, m in zip(repetitive, incompressible, mixed)]
        out = [pa.array(ratio, pa.float64()), pa.array(n, pa.int64()), pa.array(chunks, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array([x is None for x in reason], pa.bool_()), pa.array(reason, pa.string())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*b.schema.names[:-1], "ratio", "n_bytes", "chunks", "repetitive_chunks", "incompressible_chunks", "keep", "reason"])


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """doc_id, ratio, n_bytes, chunks, repetitive_chunks, incompressible_chunks, keep, reason: one row for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _batch(it, bands, chunk_bytes, level), f"doc_id long, {SCHEMA}, keep boolean, reason string")


def keep_compressible(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """The rows of docs inside the bands, all columns as they were. A map without a shuffle or a join."""
    schema = docs.schema

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = pa.RecordBatch.from_arrays([b.column(schema.names.index(text_col)).cast(pa.string())], names=["text"])
            for judged in _batch(iter([text]), bands, chunk_bytes, level):
                yield b.filter(judged.column("keep"))

    return docs.mapInArrow(kept, schema)
