"""Metrics of predictions: one pass of aggregates each, but for ranks, which sort distinct values."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored


def _by(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def _se(p: str, t: str) -> Column:
    return (F.col(p) - F.col(t)) * (F.col(p) - F.col(t))


def rmse(df: DataFrame, p: str, t: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return _by(df, keys).agg(F.sqrt(F.avg(_se(p, t))).alias("rmse"))


def pearson(df: DataFrame, p: str, t: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return _by(df, keys).agg(F.corr(p, t).alias("pearson"))


def ranked(df: DataFrame, column: str, keys: list[str], name: str, weight: str) -> DataFrame:
    """(keys, column, name): of each distinct value its average rank in its group less the group's mean rank, where a row counts weight
    times; nulls come last.

    Distinct values are range-partitioned, sorted and stored once; a value's rank is what stands before it in its part, and in the parts
    before of its group. So a group may be larger than a task, which holds no more than a part of the values."""
    values = df.groupBy(*keys, column).agg(F.sum(weight).alias("__n"))
    order = [F.col(k).asc_nulls_last() for k in [*keys, column]]
    values = stored(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))  # partition << 33 | place in it
    values = values.withColumn("__part", F.shiftright("__at", 33))
    sizes, group = values.groupBy(*keys, "__part").agg(F.sum("__n").alias("__size")), Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__size").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("__size").over(group) / 2
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a, b = values.withColumn("__upto", upto).alias("a"), sizes.withColumn("__before", before).alias("b")
    met = a.join(b, _same([*keys, "__part"], [*keys, "__part"]))
    return met.select(*(F.col(f"a.{k}").alias(k) for k in [*keys, column]), (F.col("__before") + F.col("__upto") - F.col("__n") / 2).alias(name))


def _same(a: list[str], b: list[str]) -> Column:
    """Of rows a and b: equal columns, or null on both sides."""
    return reduce(Column.__and__, (F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}")) for x, y in zip(a, b)))


def spearman(df: DataFrame, p: str, t: str, keys: list[str]) -> DataFrame:
    """Pearson's correlation of average ranks; null where either side is constant. Rows are counted by their pair of values first, and
    ranks are those of distinct values, so no group goes through one task."""
    out = stored(df.groupBy(*keys, F.col(p).alias("__p"), F.col(t).alias("__t")).agg(F.count("*").alias("__m")))
    for column, rank in (("__p", "__rp"), ("__t", "__rt")):
        both = [*keys, column]
        out = out.alias("a").join(ranked(out, column, keys, rank, "__m").alias("b"), _same(both, both)).select("a.*", f"b.{rank}")
    total = lambda x, y: F.sum(F.col("__m") * F.col(x) * F.col(y))
    square = total("__rp", "__rp") * total("__rt", "__rt")
    return _by(out, keys).agg(F.when(square > 0, total("__rp", "__rt") / F.sqrt(square)).alias("spearman"))


def regression(df: DataFrame, p: str, t: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """mse, r2 and the median absolute residual."""
    total = F.sum(F.col(t) * F.col(t)) - F.sum(t) * F.sum(t) / F.count("*")
    return _by(df, keys).agg(F.avg(_se(p, t)).alias("mse"), (1 - F.sum(_se(p, t)) / total).alias("r2"), F.median(F.abs(F.col(p) - F.col(t))).alias("median_residual"))


def inversions(x: np.ndarray) -> int:
    """Pairs i < j with x[i] > x[j], of integers from 0 on: bit by bit from the highest, ones before zeros among those equal so far."""
    out = 0
    for b in range(int(x.max()).bit_length() - 1, -1, -1) if len(x) else ():
        one = (x >> b) & 1
        head = x >> (b + 1)  # x is in order of head
        new = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        ones = np.cumsum(one)
        before = np.repeat(np.append(0, ones)[new], np.diff(np.append(new, len(x))))
        out += int((ones - before)[one == 0].sum())
        x = x[np.argsort(x >> b, kind="stable")]
    return out


def tau_b(p: np.ndarray, t: np.ndarray) -> float | None:
    """Kendall's tau-b in n log n: pairs that tie are counted by value, those that disagree as inversions."""
    def pairs(*columns: np.ndarray) -> int:
        c = np.unique(np.stack(columns), axis=1, return_counts=True)[1].astype(np.int64)
        return int((c * (c - 1) // 2).sum())

    n = len(p) * (len(p) - 1) // 2
    ranks = np.unique(t, return_inverse=True)[1].astype(np.int64)
    against = inversions(ranks[np.lexsort((t, p))])
    tie_p, tie_t = pairs(p), pairs(t)
    agree = n - tie_p - tie_t + pairs(p, t) - against
    whole = float(n - tie_p) * float(n - tie_t)
    return (agree - against) / whole**0.5 if whole else None


def kendall(df: DataFrame, p: str, t: str, keys: list[str], order: str | None = None) -> DataFrame:
    """tau-b of each group; null where either side is constant. A group's two columns are held in one task, 16 bytes a row; rows with a null
    on either side don't count. order isn't needed, since all pairs count alike."""
    rows = df.select(*keys, F.col(p).cast("double").alias("p"), F.col(t).cast("double").alias("t")).where("p is not null and t is not null")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("kendall", T.DoubleType())])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        v = tau_b(table.column("p").to_numpy(), table.column("t").to_numpy())
        return pa.table({**{k: pa.array([x.as_py()], x.type) for k, x in zip(keys, key)}, "kendall": pa.array([v], pa.float64())})

    return _by(rows, keys).applyInArrow(one, schema)


def accuracy(df: DataFrame, p: str, t: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return _by(df, keys).agg(F.avg((F.col(p) == F.col(t)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, p: str, t: str) -> DataFrame:
    return df.groupBy(F.col(t).alias("target"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))
