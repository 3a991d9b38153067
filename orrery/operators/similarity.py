"""Similarities of all pairs of two sets of vectors, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors in a block: a pair of blocks is a million pairs.
BLOCK = 1024


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    return np.divide(a @ b.T, norm, out=np.zeros(norm.shape), where=norm != 0)


def _by_difference(total) -> object:
    """Distances from differences, some rows at a time: products would lose digits of near vectors."""

    def measure(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 21) // max(1, b.size))
        return np.concatenate([total(a[i : i + step, None] - b[None]) for i in range(0, len(a), step)])

    return measure


MEASURES = {"cosine": _cosine, "euclidean": _by_difference(lambda d: np.sqrt((d * d).sum(axis=2))), "manhattan": _by_difference(lambda d: np.abs(d).sum(axis=2))}


def _blocks(vectors: DataFrame, id_col: str, vector_col: str, name: str, block: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    n = max(1, -(-rows.count() // block))
    one = F.collect_list(F.struct("id", "v")).alias(name)
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(one).drop("block")


def all_pairs(a: DataFrame, b: DataFrame, kind: str, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """a_id, b_id and v: cosine (0 where one has no length), euclidean or manhattan, of each vector of a with each of b.

    Both sides become rows of about `block` vectors, of which every pair is one matrix: as many rows are copied as there are blocks on
    the other side, not as there are vectors. Rows without an id or a vector are left out; vectors of different lengths are an error."""
    measure = MEASURES[kind]
    pairs = _blocks(a, id_col, vector_col, "a", block).crossJoin(_blocks(b, id_col, vector_col, "b", block))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken(x: pa.Scalar) -> tuple[pa.Array, np.ndarray]:
            ids, v = x.values.flatten()
            if len(np.unique(np.diff(np.asarray(v.offsets)))) > 1:
                raise ValueError("vectors of different lengths")
            return ids, v.flatten().to_numpy().reshape(len(ids), -1)

        for batch in batches:
            for x, y in zip(batch.column("a"), batch.column("b")):
                (i, p), (j, q) = taken(x), taken(y)
                if p.shape[1] != q.shape[1]:
                    raise ValueError("vectors of different lengths")
                v = measure(p, q)
                yield pa.RecordBatch.from_arrays([i.take(pa.array(np.repeat(np.arange(len(i)), len(j)))), j.take(pa.array(np.tile(np.arange(len(j)), len(i)))), pa.array(v.ravel())], names=["a_id", "b_id", "v"])

    id_type = a.select(id_col).schema[0].dataType.simpleString(), b.select(id_col).schema[0].dataType.simpleString()
    return pairs.mapInArrow(measured, f"a_id {id_type[0]}, b_id {id_type[1]}, v double")
