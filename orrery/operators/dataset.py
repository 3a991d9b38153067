"""Preparation of samples for training: sparse voxels (sample_id, gx, gy, gz, v) and tables of labels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import stored
from .grid import CELL

TINY = 1e-8


def indexed(parts: list[DataFrame], order: str) -> DataFrame:
    """The union of the parts with file_id, position in its part, and sample_index over all.

    Positions come from one window a part; offsets from the parts' counts, so no row crosses to a single task for them."""
    tagged = [p.withColumn("file_id", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged).withColumn("position", F.row_number().over(Window.partitionBy("file_id").orderBy(order)) - 1)
    counts = rows.groupBy("file_id").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.expr("b.file_id < a.file_id"), "left").groupBy("a.file_id").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "file_id").withColumn("sample_index", F.col("before") + F.col("position")).drop("before")


def normalize_minmax(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """v scaled to 0..1 within each group; 0 where all are equal."""
    by = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(by), F.max(value).over(by)
    return df.withColumn(value, F.when(hi - lo < TINY, 0.0).otherwise((F.col(value) - lo) / (hi - lo)))


def normalize_zscore(df: DataFrame, keys: list[str], value: str = "v", sample: bool = False) -> DataFrame:
    """v less its mean over its deviation within each group; 0 where that is none."""
    by = Window.partitionBy(*keys)
    mean, std = F.avg(value).over(by), (F.stddev_samp if sample else F.stddev_pop)(value).over(by)
    return df.withColumn(value, F.when(std.isNull() | F.isnan(std) | (std < TINY), 0.0).otherwise((F.col(value) - mean) / std))


def batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """batch_id and place in the batch, in order of the columns; the last batch may be smaller.

    Rows are range-partitioned and sorted once and stored with their partition and place in it; from then on both passes read the same rows:
    one counts each partition's, the other moves places by the counts of the partitions before. No row order goes through one task, and
    nothing is sorted or shuffled again. Rows that tie in the order are numbered in any order; other columns stay as they are."""
    at = F.monotonically_increasing_id()  # partition << 33 | place in it
    tagged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = tagged.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.expr("b.__p < a.__p"), "left").groupBy("a.__p").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    number = F.col("before") + place
    return tagged.withColumn("__p", part).join(F.broadcast(before), "__p").withColumns({"batch_id": F.floor(number / size), "place": number % size}).drop("__p", "__at", "before")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """shuffle_rank by md5 of seed and key: the same on every run and engine."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))))


def task_shard(df: DataFrame, order: str, tasks: int) -> DataFrame:
    """task_id from 0: consecutive parts whose sizes differ by at most one, larger ones first. For manifests."""
    return df.withColumn("task_id", F.ntile(tasks).over(Window.orderBy(order)) - 1)


def stratified_split(df: DataFrame, label: str, key: str, sizes: list[int], seed: int = 0) -> DataFrame:
    """part for each row taken: every class is cut by the sizes' shares in order of key; of a class with more rows than all sizes together,
    sizes[i] rows of part i are drawn by hash."""
    total, by = sum(sizes), Window.partitionBy(label)
    out = df.withColumn("__n", F.count("*").over(by)).withColumn("__r", F.row_number().over(by.orderBy(key)) - 1)
    upper, run = [], 0
    for s in sizes:
        run += s
        upper.append(F.floor(F.col("__n") * F.lit(run / total) + F.lit(1e-9)))
    part = F.lit(None).cast("int")
    for i in reversed(range(len(sizes))):
        part = F.when(F.col("__r") < upper[i], i).otherwise(part)
    out = out.withColumn("part", part).where("part is not null")
    draw = F.row_number().over(Window.partitionBy(label, "part").orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key))
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("part") + 1)
    return out.withColumn("__d", draw).where((F.col("__n") <= total) | (F.col("__d") <= size)).drop("__n", "__r", "__d")


def flip(voxels: DataFrame, dims: tuple[int, int, int], axes: list[int]) -> DataFrame:
    return voxels.withColumns({CELL[a]: F.lit(dims[a] - 1) - F.col(CELL[a]) for a in axes})


def rot90(voxels: DataFrame, dims: tuple[int, int, int], axis: int, times: int) -> DataFrame:
    """A quarter turn in the plane of the other two axes, from the first towards the second, repeated."""
    p, q = (CELL[a] for a in range(3) if a != axis)
    n, m = (dims[a] for a in range(3) if a != axis)
    a, b = F.col(p), F.col(q)
    for _ in range(times % 4):
        a, b = F.lit(m - 1) - b, a
        n, m = m, n
    return voxels.withColumns({p: a, q: b})


def shift(voxels: DataFrame, dims: tuple[int, int, int], by: tuple[int, int, int]) -> DataFrame:
    """Moved cells; what leaves the grid is lost."""
    out = voxels.withColumns({g: F.col(g) + s for g, s in zip(CELL, by)})
    return reduce(lambda d, gd: d.where((F.col(gd[0]) >= 0) & (F.col(gd[0]) < gd[1])), zip(CELL, dims), out)


def noise(voxels: DataFrame, keys: list[str], seed: int, scale: float = 0.1, value: str = "v") -> DataFrame:
    """Normal noise with a tenth of the group's greatest value as its deviation."""
    return voxels.withColumn(value, F.col(value) + F.randn(seed) * F.max(value).over(Window.partitionBy(*keys)) * scale)


def drop_channels(voxels: DataFrame, channel: str, gone: list[str], value: str = "v") -> DataFrame:
    return voxels.withColumn(value, F.when(F.col(channel).isin(gone), 0.0).otherwise(F.col(value)))


def channels(features: DataFrame, outkeys: list[str], keys: list[str]) -> DataFrame:
    """One column for each outkey, by sample and cell; 0 where a feature has no value."""
    return features.groupBy(*keys).pivot("outkey", outkeys).agg(F.first("v")).na.fill(0.0, outkeys)


def _hilbert(order: int, dims: int) -> list[tuple[int, ...]]:
    """The curve's points in order (transposed Gray code, undone bit by bit)."""
    out = []
    for h in range(1 << (order * dims)):
        x = [sum(((h >> (b * dims + dims - 1 - i)) & 1) << b for b in range(order)) for i in range(dims)]
        t = x[-1] >> 1
        for i in range(dims - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= t
        q = 2
        while q != 1 << order:
            p = q - 1
            for i in range(dims - 1, -1, -1):
                if x[i] & q:
                    x[0] ^= p
                else:
                    t = (x[0] ^ x[i]) & p
                    x[0] ^= t
                    x[i] ^= t
            q <<= 1
        out.append(tuple(x))
    return out


def hilbert_map(spark: SparkSession, order3: int, order2: int) -> DataFrame:
    """gx, gy, gz and the pixel px, py: both cubes' curves walked together. Its size is the grid's, not the data's."""
    a, b = _hilbert(order3, 3), _hilbert(order2, 2)
    if len(a) % len(b):
        raise ValueError(f"{len(a)} cells don't divide into {len(b)} pixels")
    k = len(a) // len(b)
    return spark.createDataFrame([(*c, *b[i // k]) for i, c in enumerate(a)], "gx int, gy int, gz int, px int, py int")


def hilbert_pool(voxels: DataFrame, keys: list[str], order3: int, order2: int, mode: str = "max") -> DataFrame:
    """keys, px, py, v: cells pooled to a square along Hilbert's curve; cells without a row are 0."""
    k = (1 << (3 * order3)) // (1 << (2 * order2))
    met = voxels.join(F.broadcast(hilbert_map(voxels.sparkSession, order3, order2)), list(CELL)).groupBy(*keys, "px", "py")
    if mode == "mean":
        return met.agg((F.sum("v") / k).alias("v"))
    if mode != "max":
        raise ValueError(f"mode {mode!r}")
    return met.agg(F.when(F.count("*") < k, F.greatest(F.max("v"), F.lit(0.0))).otherwise(F.max("v")).alias("v"))


def voxel_slice(voxels: DataFrame, axis: str, at: int, keys: list[str]) -> DataFrame:
    """A plane, over the greatest value of each group's whole grid."""
    return voxels.withColumn("share", F.col("v") / F.max("v").over(Window.partitionBy(*keys))).where(F.col(axis) == at)


def voxel_percentile(voxels: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """Cells of at least the percentile (linear) of their group's values above 1e-6."""
    some = voxels.where("v > 1e-6")
    bar = some.groupBy(*keys).agg(F.percentile("v", F.lit(percent / 100)).alias("bar"))
    return some.join(bar, keys).where("v >= bar - 1e-12")  # interpolating between equals may miss them by a bit


def upsert(store: DataFrame, update: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """store with update's values in place of its own, and update's other rows."""
    new = update.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__has"))
    return store.join(new, keys, "full").withColumn(value, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__has")


def scrub(column: str) -> Column:
    """NaN as 0 and infinities as the greatest finite values."""
    big = 1.7976931348623157e308
    c = F.col(column)
    return F.when(F.isnan(c), 0.0).when(c > big, big).when(c < -big, -big).otherwise(c)


def rotations(points: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Each group's points about its centroid, in n**3 frames: Euler angles on a grid from -pi to pi (both ends), about x, then y, then z."""
    centroid = points.groupBy(*keys).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    own = points.join(centroid, keys).select(*points.columns, *((F.col(a) - F.col(f"c{a}")).alias(f"d{a}") for a in "xyz"))
    pi = 3.141592653589793
    angles = [(i * n * n + j * n + k, *(-pi + 2 * pi * t / (n - 1) if n > 1 else -pi for t in (i, j, k))) for i, j, k in product(range(n), repeat=3)]
    grid = points.sparkSession.createDataFrame(angles, "rotation int, a double, b double, c double")
    ca, sa, cb, sb, cc, sc = F.cos("a"), F.sin("a"), F.cos("b"), F.sin("b"), F.cos("c"), F.sin("c")
    x, y, z = F.col("dx"), F.col("dy"), F.col("dz")
    y1, z1 = ca * y - sa * z, sa * y + ca * z
    x2, z2 = cb * x + sb * z1, cb * z1 - sb * x
    out = own.crossJoin(F.broadcast(grid))
    return out.select(*[c for c in points.columns if c not in "xyz"], "rotation", (cc * x2 - sc * y1).alias("x"), (sc * x2 + cc * y1).alias("y"), z2.alias("z"))


def nearest_prototype(queries: DataFrame, prototypes: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """The distinct queries with predicted: the label of the nearest prototype, columns over the prototypes' deviations; the least label of
    equals. What has no distance, for a null or NaN, is furthest.

    prototypes is a small dimension table; it is checked to stay one, and sent along. Some queries at a time are compared with all of them,
    so no table of pairs is made."""
    stats = prototypes.agg(F.count("*").alias("n"), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    scale = np.array([float(stats[f"s_{c}"] or 0) or 1e9 for c in columns])
    if stats["n"] * (len(columns) + 1) * 8 > 32 << 20:
        raise ValueError(f"{stats['n']} prototypes are too many to compare each query with")
    known = prototypes.select(F.col(label).alias("label"), *(F.col(c).cast("double").alias(f"p_{i}") for i, c in enumerate(columns))).orderBy("label").toArrow()
    labels = known.column("label").combine_chunks()
    points = [known.column(f"p_{i}").to_numpy() for i in range(len(columns))]
    rows, names = queries.distinct(), [*queries.columns, "predicted"]
    if not stats["n"]:
        return rows.limit(0).withColumn("predicted", F.lit(None).cast(prototypes.schema[label].dataType))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // len(labels))
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns[-len(columns) :]]
            at = np.zeros(batch.num_rows, np.int64)
            for i in range(0, batch.num_rows, step):
                d = sum(((v[i : i + step, None] - p) / s) ** 2 for v, p, s in zip(values, points, scale))
                at[i : i + step] = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(columns)], labels.take(pa.array(at))], names=names)

    schema = T.StructType([*queries.schema, T.StructField("predicted", prototypes.schema[label].dataType)])
    return rows.select("*", *(F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns))).mapInArrow(predicted, schema)


def segments(df: DataFrame, keys: list[str], begin: str, total: str) -> DataFrame:
    """Size of each segment from its begin to the next one's, or to the total."""
    after = F.lead(begin).over(Window.partitionBy(*keys).orderBy(begin))
    return df.withColumn("size", F.coalesce(after, F.col(total)) - F.col(begin))


def pick_segment(sized: DataFrame, keys: list[str], wanted: str, tolerance: int = 4) -> DataFrame:
    """keys, begin, size and rule of the segment that is taken for a wanted size: the last if it is within tolerance, else the first of
    exactly that size, else the first of the nearest if nearer than tolerance; else none."""
    diff = F.abs(F.col("size") - F.col(wanted))
    at = F.struct("begin", "size")
    by = sized.groupBy(*keys).agg(
        F.max_by(at, "begin").alias("last"), F.max_by(diff, "begin").alias("last_diff"), F.min_by(at, F.struct(diff.alias("d"), "begin")).alias("near"), F.min(diff).alias("near_diff")
    )
    rule = F.when(F.col("last_diff") <= tolerance, "last").when(F.col("near_diff") == 0, "exact").when(F.col("near_diff") < tolerance, "near")
    out = by.withColumn("rule", rule).withColumn("s", F.when(F.col("rule") == "last", F.col("last")).otherwise(F.col("near")))
    return out.where("rule is not null").select(*keys, F.col("s.begin").alias("begin"), F.col("s.size").alias("size"), "rule")
