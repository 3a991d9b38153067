"""Frames to one value: aggregates of a series of which only some frames have a row.

A frame without a row counts as `empty`. Nothing is densified: the missing frames enter by their number, so a group holds its own rows
and never frames times cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = ("mean", "std", "median", "var", "max", "min", "entropy", "drift")
PLAIN = frozenset(AGGREGATES) - {"median", "entropy"}
BINS = 16


def _entropy(rows: DataFrame, keys: list[str], empty: float) -> DataFrame:
    """Bits of the histogram over BINS equal bins from least to greatest; 0 where these are equal.

    Ends come from a window over the keys, whose partitioning also serves both groupings after it: one exchange."""
    over, e = Window.partitionBy(*keys), F.lit(float(empty))
    have = F.count("*").over(over)
    ends = rows.withColumns({"__k": F.col("__n") - have, "__lo": F.min("__v").over(over), "__hi": F.max("__v").over(over)})
    some = F.col("__k") > 0
    ends = ends.withColumns({"__lo": F.when(some, F.least("__lo", e)).otherwise(F.col("__lo")), "__hi": F.when(some, F.greatest("__hi", e)).otherwise(F.col("__hi"))})
    width = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    place = lambda v: F.coalesce(F.least(F.floor((v - F.col("__lo")) / width * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    counts = ends.withColumns({"__b": place(F.col("__v")), "__e": place(e)}).groupBy(*keys, "__b").agg(F.count("*").alias("__c"), *(F.first(c).alias(c) for c in ("__n", "__k", "__e")))
    bits = lambda c: -(c / F.col("__n")) * F.log2(c / F.col("__n"))
    with_empty = counts.withColumn("__bits", bits(F.col("__c") + F.when(F.col("__b") == F.col("__e"), F.col("__k")).otherwise(0.0)))
    # the empty frames' bin, where no other value lies in it
    alone = F.when((F.max((F.col("__b") == F.col("__e")).cast("int")) == 0) & (F.first("__k") > 0), -(F.first("__k") / F.first("__n")) * F.log2(F.first("__k") / F.first("__n"))).otherwise(0.0)
    return with_empty.groupBy(*keys).agg((F.sum("__bits") + alone).alias("v"))


def plain(kind: str, v: Column, f: Column, n: Column, empty: float) -> Column:
    """The aggregate of a group's values v of frames f, of n frames in all: sums and extremes alone, so that several share one grouping."""
    have, e = F.count("*"), F.lit(float(empty))
    missing = n - have
    if kind == "mean":
        return (F.sum(v) + missing * e) / n
    if kind in ("var", "std"):
        # two sets of values, one of them constant: their squares about the common mean, without cancellation
        gap = F.avg(v) - e
        out = (F.var_pop(v) * have + gap * gap * have * missing / n) / n
        return F.sqrt(out) if kind == "std" else out
    if kind in ("max", "min"):
        best, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
        return F.when(missing > 0, pick(best(v), e)).otherwise(best(v))
    # slope of least squares on frames 0 to n - 1; missing frames add nothing once values are taken from `empty`
    fv, s = F.sum(f * (v - e)), F.sum(v - e)
    return F.when(n <= 1, 0.0).otherwise((n * fv - n * (n - 1) / 2 * s) / (n * (n - 1) * n * (2 * n - 1) / 6 - n * (n - 1) / 2 * (n * (n - 1) / 2)))


def aggregate_frames(df: DataFrame, kind: str | Callable[[Column, Column], Column], keys: list[str], n_frames: int | Column, frame: str = "frame", value: str = "v", empty: float = 0.0) -> DataFrame:
    """keys and v. frame runs from 0 to n_frames - 1 within a group; n_frames may be a column that is constant in it.

    All but the median are plain aggregates with a partial step; the median sorts a group's own values. kind may be a function of one's own:
    it gets a group's values as an array (in no order, empty frames included) and their number."""
    n_col = F.lit(n_frames) if isinstance(n_frames, int) else n_frames
    rows = df.select(*keys, F.col(frame).cast("double").alias("__f"), F.col(value).cast("double").alias("__v"), n_col.cast("double").alias("__n"))
    by, n, e = rows.groupBy(*keys), F.first("__n"), F.lit(float(empty))
    if callable(kind):
        missing = n - F.count("*")
        held = by.agg(F.concat(F.collect_list("__v"), F.array_repeat(e, missing.cast("int"))).alias("__a"), n.alias("__n"))
        return held.select(*keys, kind(F.col("__a"), F.col("__n")).alias("v"))
    if kind in PLAIN:
        return by.agg(plain(kind, F.col("__v"), F.col("__f"), n, empty).alias("v"))
    if kind == "median":
        held = by.agg(F.sort_array(F.collect_list("__v")).alias("__a"), n.alias("__n"), F.count(F.when(F.col("__v") < e, 1)).alias("__less"))
        gone = F.col("__n") - F.size("__a")

        def ranked(i: Column) -> Column:
            """The i-th value (from 1) with the empty frames in their place among the sorted ones."""
            at = lambda j: F.try_element_at("__a", j.cast("int"))
            return F.when(i <= F.col("__less"), at(i)).when(i <= F.col("__less") + gone, e).otherwise(at(F.greatest(i - gone, F.lit(1.0))))

        return held.select(*keys, ((ranked(F.floor((F.col("__n") + 1) / 2)) + ranked(F.floor(F.col("__n") / 2) + 1)) / 2).alias("v"))
    if kind == "entropy":
        return _entropy(rows, keys, empty)
    raise ValueError(f"no aggregate {kind!r}; there are {', '.join(AGGREGATES)}")


def summation(df: DataFrame, value: str = "v") -> DataFrame:
    return df.agg(F.sum(value).alias("v"))
