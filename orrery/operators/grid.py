"""Atoms and grids: coordinates, crops, the distance join as an offset stencil, densities.

Points are rows with x, y, z; cells are gx, gy, gz. The joins within a cutoff never compare all pairs: each point is exploded to the cells that
can be near it, so the work grows with (cutoff / spacing)**3, not with the grid, and nothing is shuffled or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import GridSpec

CELL = ("gx", "gy", "gz")
AXES = ("x", "y", "z")


def grid_points(spark: SparkSession, dims: tuple[int, int, int]) -> DataFrame:
    """gx, gy, gz of every cell."""
    gx, gy, gz = (spark.range(d).select(F.col("id").cast("int").alias(c)) for d, c in zip(dims, CELL))
    return gx.crossJoin(gy).crossJoin(gz)


def grid_coords(spark: SparkSession, grid: GridSpec, center: tuple[float, float, float]) -> DataFrame:
    """Coordinates of the cells of a box around center: index * length / dims + center - length / 2; the far end is left out."""
    cols = [(F.col(g) * F.lit(n / d) + F.lit(c - n / 2)).alias(a) for g, a, n, d, c in zip(CELL, AXES, grid.lengths, grid.dims, center)]
    return grid_points(spark, grid.dims).select(*CELL, *cols)


def grid_linspace(spark: SparkSession, center: tuple[float, float, float], lengths: tuple[float, float, float], counts: tuple[int, int, int]) -> DataFrame:
    """As grid_coords, but with both ends of the box."""
    cols = [(F.lit(c - n / 2) + F.col(g) * F.lit(n / (k - 1) if k > 1 else 0.0)).alias(a) for g, a, n, k, c in zip(CELL, AXES, lengths, counts, center)]
    return grid_points(spark, counts).select(*CELL, *cols)


def translate(points: DataFrame, grid: GridSpec, focus: tuple[str, str, str] = ("fx", "fy", "fz")) -> DataFrame:
    """Points seen from a focus at the grid's center: p - focus + center - spacing / 2."""
    return points.withColumns({a: F.col(a) - F.col(f) + F.lit(c - grid.spacing / 2) for a, f, c in zip(AXES, focus, grid.center)})


def translate_to_centroid(points: DataFrame, grid: GridSpec, keys: list[str]) -> DataFrame:
    """Points with each group's centroid at the grid's center."""
    centroid = points.groupBy(*keys).agg(*(F.avg(a).alias(f"c{a}") for a in AXES))
    moved = points.join(centroid, keys).withColumns({a: F.col(a) - F.col(f"c{a}") + F.lit(c) for a, c in zip(AXES, grid.center)})
    return moved.drop(*(f"c{a}" for a in AXES))


def inside(grid: GridSpec, padding: float) -> Column:
    """Whether a translated point lies in the grid's padded box, strictly on each side."""
    h = grid.spacing / 2
    out = F.lit(True)
    for a, n in zip(AXES, grid.lengths):
        out = out & (F.col(a) > F.lit(-padding - h)) & (F.col(a) < F.lit(n + padding - h))
    return out


def crop(points: DataFrame, grid: GridSpec, padding: float, by_residue: bool = False, frame_keys: tuple[str, ...] = ("traj_id", "frame")) -> DataFrame:
    """Points in the padded box; by_residue keeps every atom of a residue with one in it."""
    if not by_residue:
        return points.where(inside(grid, padding))
    keys = [*frame_keys, "resid"]
    return points.join(points.where(inside(grid, padding)).select(*keys).distinct(), keys, "left_semi")


def box_filter(points: DataFrame, center: tuple[float, float, float], lengths: tuple[float, float, float]) -> DataFrame:
    """Points strictly within half a length of the center on each axis."""
    cond = F.lit(True)
    for a, c, n in zip(AXES, center, lengths):
        cond = cond & (F.col(a) > F.lit(c - n / 2)) & (F.col(a) < F.lit(c + n / 2))
    return points.where(cond)


def _stencil(grid: GridSpec, cutoff: float, inclusive: bool, on_lattice: bool) -> str:
    """The stencil as one constant array of packed offsets."""
    offsets = grid.offsets(cutoff, inclusive, on_lattice)
    if offsets and max(max(map(abs, o)) for o in offsets) > 127:
        raise ValueError("a cutoff of more than 126 cells")
    return "array(" + ",".join(str(((i + 128) << 16) | ((j + 128) << 8) | (k + 128)) for i, j, k in offsets) + ")"


def _number(v: float) -> str:
    return f"{float(v)!r}D"


def spread_out(points: DataFrame, keys: list[str]) -> DataFrame:
    """points by keys over as many partitions as a shuffle has, however few bytes they are: each becomes hundreds of rows.

    Points move instead of what they become: groups of the keys and a cell then lie in one partition, and need no exchange of their own."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def near_cells(points: DataFrame, grid: GridSpec, cutoff: float, inclusive: bool = True, on_lattice: bool = False) -> DataFrame:
    """Each point once for each cell of the grid within the cutoff, with gx, gy, gz and the squared distance d2.

    on_lattice: the points stand on cells exactly, which makes the stencil smaller."""
    s = _number(grid.spacing)
    cells = [f"cast(floor({a} / {s}) as int) + ((shiftright(__o, {16 - 8 * i}) & 255) - 128) as {g}" for i, (g, a) in enumerate(zip(CELL, AXES))]
    far = [f"({a} - {g} * {s})" for g, a in zip(CELL, AXES)]
    # few and long expressions: each call to the JVM costs as much as a thousand rows
    out = points.selectExpr("*", f"explode({_stencil(grid, cutoff, inclusive, on_lattice)}) as __o").selectExpr("*", *cells).drop("__o")
    out = out.where(" and ".join(f"{g} >= 0 and {g} < {d}" for g, d in zip(CELL, grid.dims)))
    return out.selectExpr("*", " + ".join(f"{d} * {d}" for d in far) + " as d2").where(f"d2 {'<=' if inclusive else '<'} {_number(float(cutoff) ** 2)}")


def smear(points: DataFrame, grid: GridSpec, cutoff: float, sigma: float, weight: str = "w", on_lattice: bool = False) -> DataFrame:
    """Each point's weight spread over the cells nearer than the cutoff, with gx, gy, gz and v.

    The spread sums to the weight over a lattice that reaches border() cells beyond the grid; what falls outside the grid is lost.
    A point's sum is needed before its cells part, so this is a map over Arrow batches in numpy: without a shuffle, and ten times as fast as
    an array that higher-order functions build and reduce (these are not compiled)."""
    offsets = np.array(grid.offsets(cutoff, False, on_lattice), np.int64).reshape(-1, 3)
    border, s, dims = grid.border(cutoff), float(grid.spacing), np.array(grid.dims)
    names = points.columns
    scale = 0.0 if sigma == 0 else 1 / (sigma * sqrt(2 * pi))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // max(1, len(offsets)))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                p = np.stack([b.column(names.index(a)).cast(pa.float64()).to_numpy(zero_copy_only=False) for a in AXES], axis=1)
                w = b.column(names.index(weight)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                known = np.isfinite(p).all(axis=1)
                base = np.floor(np.where(known[:, None], p, 0) / s).astype(np.int64)
                d2, on, within = 0.0, known[:, None], True
                for a in range(3):  # an axis at a time
                    at = base[:, a, None] + offsets[None, :, a]
                    d2 = d2 + (p[:, a, None] - at * s) ** 2
                    on = on & (at >= -border) & (at < dims[a] + border)
                    within = within & (at >= 0) & (at < dims[a])
                g = np.where(on & (d2 < cutoff * cutoff), np.exp(-d2 / (2.0 * sigma * sigma or 1.0)) * scale, 0.0)
                total = g.sum(axis=1)
                row, k = np.nonzero(within & (g > 0) & (total > 0)[:, None] & (w != 0)[:, None] & ~np.isnan(w)[:, None])
                cells = (base[row] + offsets[k]).astype(np.int32)
                columns = [c.take(pa.array(row)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(cells[:, a]) for a in range(3)), pa.array(w[row] * g[row, k] / total[row])], names=[*names, *CELL, "v"])

    schema = T.StructType([*points.schema.fields, *(T.StructField(c, T.IntegerType()) for c in CELL), T.StructField("v", T.DoubleType())])
    return points.mapInArrow(spread, schema)


def voxelize(points: DataFrame, grid: GridSpec, cutoff: float, sigma: float, keys: list[str], weight: str = "w", on_lattice: bool = False) -> DataFrame:
    """Density v of each touched cell for each group of keys."""
    return smear(spread_out(points.select(*keys, *AXES, weight), keys), grid, cutoff, sigma, weight, on_lattice).groupBy(*keys, *CELL).agg(F.sum("v").alias("v"))


def discretize(points: DataFrame, grid: GridSpec, keys: list[str], weight: str = "w") -> DataFrame:
    """Sum of weights of the points in each cell floor(p / spacing) of the grid."""
    out = points.select(*keys, weight, *(F.floor(F.col(a) / F.lit(grid.spacing)).cast("int").alias(g) for a, g in zip(AXES, CELL)))
    for g, d in zip(CELL, grid.dims):
        out = out.where((F.col(g) >= 0) & (F.col(g) < d))
    return out.groupBy(*keys, *CELL).agg(F.sum(weight).alias("v"))
