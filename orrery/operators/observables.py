"""Observables: what a cell sees of the atoms within the cutoff (inclusive), one value for each frame and cell."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import GridSpec
from .grid import AXES, CELL, near_cells, spread_out

OBSERVABLES = ("existence", "direct_count", "distinct_count", "mean_distance", "cumulative_weight", "density", "dispersion", "eccentricity", "radius_of_gyration")


def empty_value(kind: str, cutoff: float) -> float:
    """What a cell without atoms has."""
    return float(cutoff) if kind == "eccentricity" else 0.0


#: Pairs held at once.
PAIRS = 1 << 19


def _pair_sums(w: np.ndarray, axes: list[np.ndarray]) -> tuple[float, float]:
    """Weighted distances and weights of all ordered pairs of one large cell, some rows of the pairs' matrix at a time."""
    n, far, total = len(w), 0.0, 0.0
    for i in range(0, n, max(1, PAIRS // n)):
        part = slice(i, i + max(1, PAIRS // n))
        ww = w[part, None] * w[None, :]
        ww[np.arange(len(ww)), np.arange(i, i + len(ww))] = 0
        far += (ww * np.sqrt(sum((x[part, None] - x[None, :]) ** 2 for x in axes))).sum()
        total += ww.sum()
    return far, total


def _dispersion(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's points to the mean of their pairs' distances, weighted by both weights; 0 without weight. Rows of as many points go together."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        start = np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0]
        size, flat = np.diff(np.asarray(lists.offsets)), lists.flatten()
        w, *axes = (np.asarray(c) for c in flat.flatten())
        out = np.zeros(len(start))
        for n in np.unique(size[size > 1]).tolist():
            rows, step = np.flatnonzero(size == n), max(1, PAIRS // (n * n))
            if n * n > PAIRS:
                for i in rows.tolist():
                    at = slice(start[i], start[i] + n)
                    far, total = _pair_sums(w[at], [x[at] for x in axes])
                    out[i] = far / total if total else 0.0
                continue
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                at = start[r][:, None] + np.arange(n)
                d2 = sum((x[at][:, :, None] - x[at][:, None, :]) ** 2 for x in axes)
                ww = w[at][:, :, None] * w[at][:, None, :]
                ww[:, np.arange(n), np.arange(n)] = 0
                total = ww.sum(axis=(1, 2))
                out[r] = np.divide((ww * np.sqrt(d2)).sum(axis=(1, 2)), total, out=np.zeros(len(r)), where=total != 0)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=[*b.schema.names[:-1], "v"])


def _measure(kind: str, cutoff: float, spacing: float, weight: str, tag: str) -> tuple[list[str], str]:
    """The aggregates that a kind needs, named by tag, and its value from them, in SQL."""
    w, c = f"cast(`{weight}` as double)", lambda name: f"`{tag}{name}`"
    total, number = f"sum({w}) as {c('s')}", f"count(*) as {c('n')}"
    # relative to the cell, coordinates are at most the cutoff: sums of squares keep their digits
    moments = [total, number, *(f"sum({w} * ({a} - {g} * {float(spacing)!r}D)) as {c('s' + a)}" for a, g in zip(AXES, CELL))]
    length2 = f"(({c('sx')} * {c('sx')} + {c('sy')} * {c('sy')} + {c('sz')} * {c('sz')}) / ({c('s')} * {c('s')}))"
    if kind == "existence":
        return [number], "1.0D"
    if kind == "direct_count":
        return [number], f"cast({c('n')} as double)"
    if kind == "distinct_count":
        return [f"count(distinct {w}) as {c('u')}"], f"cast({c('u')} as double)"
    if kind == "mean_distance":
        return [total, f"sum(sqrt(d2) * {w}) as {c('d')}"], f"{c('d')} / nullif({c('s')}, 0.0D)"
    if kind == "cumulative_weight":
        return [total], c("s")
    if kind == "density":
        return [total], f"{c('s')} / {4 / 3 * pi * cutoff**3!r}D"
    if kind == "eccentricity":
        return moments, f"case when {c('s')} = 0 then {float(cutoff)!r}D else sqrt({length2}) end"
    if kind == "radius_of_gyration":
        square = f"sum({w} * d2) as {c('s2')}"
        return [*moments, square], f"case when {c('n')} <= 1 or {c('s')} = 0 then 0.0D else sqrt(greatest(0.0D, {c('s2')} / {c('s')} - {length2})) end"
    raise ValueError(f"no observable {kind!r}; there are {', '.join(OBSERVABLES)}")


def observed_together(near: DataFrame, wanted: list[tuple[str, str, str]], cutoff: float, spacing: float, keys: list[str]) -> DataFrame:
    """keys, gx, gy, gz and a column for each of wanted (name, kind, weight column), from one grouping of near_cells(). No dispersion."""
    parts = [(name, *_measure(kind, cutoff, spacing, weight, f"__{i}_")) for i, (name, kind, weight) in enumerate(wanted)]
    by = near.groupBy(*keys, *CELL).agg(*(F.expr(a) for _, aggregates, _ in parts for a in aggregates))
    return by.selectExpr(*(f"`{k}`" for k in (*keys, *CELL)), *(f"{value} as `{name}`" for name, _, value in parts))


def observed(near: DataFrame, kind: str, cutoff: float, spacing: float, keys: list[str], weight: str = "w") -> DataFrame:
    """keys, gx, gy, gz and v, from rows of near_cells()."""
    if kind != "dispersion":
        return observed_together(near, [("v", kind, weight)], cutoff, spacing, keys)
    w = F.col(weight).cast("double")
    points = F.collect_list(F.struct(w.alias("w"), *((F.col(a) - F.col(g) * F.lit(float(spacing))).alias(f"d{a}") for a, g in zip(AXES, CELL))))
    held = near.groupBy(*keys, *CELL).agg(points.alias("p"))
    return held.mapInArrow(_dispersion, T.StructType([*held.schema.fields[:-1], T.StructField("v", T.DoubleType())]))


def observe(points: DataFrame, grid: GridSpec, kind: str, cutoff: float, keys: list[str], weight: str = "w", on_lattice: bool = False) -> DataFrame:
    """The observable for each group of keys (with the frame among them) and each cell that sees an atom."""
    near = near_cells(spread_out(points.select(*keys, *AXES, weight), keys), grid, cutoff, True, on_lattice)
    return observed(near, kind, cutoff, grid.spacing, keys, weight)
