"""Scalar and array functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .constants import BOND_LENGTH, ELEMENTS, OTHER_BOND, SUPERSEDED, lookup


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def msd(rows: Column) -> Column:
    """Mean of the population deviations of the rows of a matrix."""
    mean = lambda r: _sum(r) / F.size(r)
    std = lambda r: F.sqrt(_sum(F.transform(r, lambda v: (v - mean(r)) * (v - mean(r)))) / F.size(r))
    return _sum(F.transform(rows, std)) / F.size(rows)


def hash_text(value: Column, kind: str = "md5") -> Column:
    """Hex digest of a text, or of an array's elements joined by commas."""
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        raise ValueError(f"no digest {kind!r}")
    return F.md5(value) if kind == "md5" else F.sha1(value) if kind == "sha1" else F.sha2(value, int(kind[3:]))


def structure_code(code: Column) -> Column:
    """Lower case, and the newer code where one supersedes it."""
    low = F.lower(F.trim(code))
    return lookup(low, SUPERSEDED, low)


def element_property(z: Column, field: str, strict: bool = True) -> Column:
    """A property of the elements by atomic number; strict raises where it is unknown, as a lookup would."""
    found = lookup(z, {k: v[field] for k, v in ELEMENTS.items() if v[field] is not None})
    missing = F.raise_error(F.concat(F.lit(f"no {field} for atomic number "), z.cast("string"))).cast("string" if field == "symbol" else "double")
    return F.coalesce(found, F.when(z.isNotNull(), missing)) if strict else found


def bond_too_long(kind: Column, length: Column, tolerance: float = 0.1) -> Column:
    """Whether a bond (such as 'C-N') is longer than usual, by more than the relative tolerance."""
    usual = lookup(kind, BOND_LENGTH, F.lit(OTHER_BOND))
    return (length > usual) & (F.abs(length - usual) > tolerance * F.abs(usual) + 1e-8)


def penalty(similarity: Column, reference: Column, scale: float = 0.1, most: float = 0.95) -> Column:
    return (F.lit(most) - similarity) * reference * F.lit(scale)


def runs(df: DataFrame, keys: list[str], order: str, flag: str, most: int) -> DataFrame:
    """The `most` longest runs of rows with flag, in each group by order: keys, rank, begin, n. Of equal runs the first comes first."""
    by = Window.partitionBy(*keys).orderBy(order)
    island = df.withColumn("__i", F.row_number().over(by) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))).where(flag)
    found = island.groupBy(*keys, "__i").agg(F.min(order).alias("begin"), F.count("*").alias("n"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "begin")))
    return ranked.where(F.col("rank") <= most).select(*keys, "rank", "begin", "n")


def entropy_of_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the entropy (bits) of a discrete column."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    share = F.col("__c") / F.sum("__c").over(Window.partitionBy(*keys))
    return counts.withColumn("__p", share).groupBy(*keys).agg(F.sum(-F.col("__p") * F.log2(F.col("__p") + F.lit(1e-10))).alias("entropy"))


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """keys, bin from 0, n; the last bin takes hi, values outside are left out."""
    b = F.least(F.floor((F.col(value) - lo) / F.lit((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return df.where(F.col(value).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def stamp(at: Column | None = None) -> Column:
    """A run's mark: date, time and four digits of the nanoseconds."""
    t = F.current_timestamp() if at is None else at
    return F.concat(F.date_format(t, "yyMMdd_HHmmss_"), F.lpad((F.unix_micros(t) % 10_000).cast("string"), 4, "0"))


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows by chance, without replacement; a top-n of random numbers, so nothing is sorted as a whole."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")
