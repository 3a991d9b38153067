"""Grid kernels against plain numpy over dense arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import grid as g
from orrery.operators.framewise import AGGREGATES, aggregate_frames
from orrery.operators.observables import OBSERVABLES, empty_value, observe
from orrery.spec import FeatureSpec, GridSpec


def frame_of(spark, coords, weights):
    """coords (frames, atoms, 3), weights (atoms,)."""
    rows = [(f, a, *map(float, coords[f, a]), float(weights[a])) for f in range(coords.shape[0]) for a in range(coords.shape[1])]
    return spark.createDataFrame(rows, "frame int, atom_id int, x double, y double, z double, w double")


def cells(grid):
    return np.stack(np.meshgrid(*(np.arange(d) for d in grid.dims), indexing="ij"), axis=-1).reshape(-1, 3)


def dense(df, grid, keys=()):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), np.zeros(grid.dims))[r.gx, r.gy, r.gz] = r.v
    return out if keys else out.get((), np.zeros(grid.dims))


def density(p, w, grid, cutoff, sigma):
    """Each atom normalised over the lattice that is wider by the border."""
    b, s = grid.border(cutoff), grid.spacing
    axes = [np.arange(-b, d + b) for d in grid.dims]
    lattice = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1)
    out = np.zeros(grid.dims)
    for q, v in zip(p, w):
        d2 = ((lattice * s - q) ** 2).sum(-1)
        k = np.where(d2 < cutoff**2, np.exp(-d2 / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi)), 0)
        if v and k.sum():
            x, y, z = (slice(b, b + d) for d in grid.dims)
            out += (v * k / k.sum())[x, y, z]
    return out


@pytest.mark.parametrize("dims, spacing, cutoff", [((6, 6, 6), 1.0, 2.5), ((5, 7, 4), 0.5, 1.2)])
def test_density(spark, dims, spacing, cutoff):
    rng = np.random.default_rng(0)
    grid = GridSpec(dims, spacing)
    p = rng.uniform(-3 * spacing, (max(dims) + 3) * spacing, (1, 40, 3))
    w = np.append(rng.uniform(-1, 2, 39), 0)
    got = dense(g.voxelize(frame_of(spark, p, w), grid, cutoff, 1.0, ["frame"]).drop("frame"), grid)
    assert np.allclose(got, density(p[0], w, grid, cutoff, 1.0))


def test_density_conserves_inside_and_leaks_at_the_border(spark):
    grid = GridSpec(32, 0.5)
    rng = np.random.default_rng(0)
    p = np.clip(rng.normal(5, 1, (1, 100, 3)), 1, 14)
    total = g.voxelize(frame_of(spark, p, np.full(100, 16.0)), grid, 0.9, 1.0, ["frame"]).agg(F.sum("v")).first()[0]
    assert total == pytest.approx(1600)
    edge = g.voxelize(frame_of(spark, np.array([[[0.0, 8, 8]]]), np.ones(1)), grid, 0.9, 1.0, ["frame"]).agg(F.sum("v")).first()[0]
    assert 0.5 < edge < 1
    assert g.voxelize(frame_of(spark, np.array([[[-9.0, 8, 8]]]), np.ones(1)), grid, 0.9, 1.0, ["frame"]).count() == 0


def value(kind, d, p, w, at, cutoff):
    if not len(d):
        return empty_value(kind, cutoff)
    s = w.sum()
    if kind == "existence":
        return 1
    if kind == "direct_count":
        return len(d)
    if kind == "distinct_count":
        return len(set(w))
    if kind == "mean_distance":
        return (d * w).sum() / s
    if kind == "cumulative_weight":
        return s
    if kind == "density":
        return s / (4 / 3 * math.pi * cutoff**3)
    com = (p * w[:, None]).sum(0) / s
    if kind == "eccentricity":
        return np.linalg.norm(com - at)
    if kind == "radius_of_gyration":
        return math.sqrt((w * ((p - com) ** 2).sum(1)).sum() / s) if len(d) > 1 else 0
    i, j = np.triu_indices(len(d), 1)
    ww = w[i] * w[j]
    return (ww * np.linalg.norm(p[i] - p[j], axis=1)).sum() / ww.sum() if ww.sum() else 0


@pytest.mark.parametrize("kind", OBSERVABLES)
def test_observables(spark, kind):
    rng = np.random.default_rng(1)
    grid, cutoff = GridSpec((4, 5, 3), 0.8), 1.3
    p, w = rng.uniform(-1, 4, (2, 25, 3)), rng.integers(1, 4, 25).astype(float)
    got = dense(observe(frame_of(spark, p, w), grid, kind, cutoff, ["frame"]), grid, ["frame"])
    for f in range(2):
        for c in cells(grid):
            d = np.linalg.norm(p[f] - c * grid.spacing, axis=1)
            near = d <= cutoff
            if near.any():
                assert got[(f,)][tuple(c)] == pytest.approx(value(kind, d[near], p[f][near], w[near], c * grid.spacing, cutoff), abs=1e-9)


def test_cutoffs_at_the_boundary(spark):
    grid = GridSpec(5)
    p = frame_of(spark, np.array([[[2.0, 2, 2]]]), np.ones(1))
    for lattice in (False, True):
        assert g.near_cells(p, grid, 2.0, True, lattice).count() == 33
        assert g.near_cells(p, grid, 2.0, False, lattice).count() == 27
    moved = p.withColumns({a: F.lit(v) for a, v in zip("xyz", (-1.5, 0.0, 4.499))})
    assert g.crop(moved, grid, 1.0).count() == 0 and g.crop(moved, grid, 1.001).count() == 1


AGG = {
    "mean": np.mean, "std": np.std, "median": np.median, "var": np.var, "max": np.max, "min": np.min,
    "drift": lambda v: np.polyfit(np.arange(len(v)), v, 1)[0] if len(v) > 1 else 0.0,
    "entropy": lambda v: 0.0 if np.ptp(v) == 0 else (lambda p: -(p[p > 0] * np.log2(p[p > 0])).sum())(np.bincount(np.minimum(((v - v.min()) / np.ptp(v) * 16).astype(int), 15)) / len(v)),
}


@pytest.mark.parametrize("kind", AGGREGATES)
@pytest.mark.parametrize("empty", [0.0, 2.5])
def test_frame_aggregates(spark, kind, empty):
    rng = np.random.default_rng(2)
    series = [rng.integers(-8, 9, n).astype(float) for n in (1, 2, 7, 50) for _ in range(3)]
    keep = [rng.random(len(s)) < 0.6 for s in series]
    rows = [(i, f, float(v), len(s)) for i, (s, k) in enumerate(zip(series, keep)) for f, (v, h) in enumerate(zip(s, k)) if h]
    df = spark.createDataFrame(rows, "i int, frame int, v double, n int")
    got = {r.i: r.v for r in aggregate_frames(df, kind, ["i"], F.col("n"), empty=empty).collect()}
    for i, (s, k) in enumerate(zip(series, keep)):
        if k.any():
            assert got[i] == pytest.approx(AGG[kind](np.where(k, s, empty)), abs=1e-9)


def test_own_aggregate(spark):
    df = spark.createDataFrame([(0, 0, 3.0), (0, 2, 5.0), (1, 1, 2.0)], "i int, frame int, v double")
    got = {r.i: r.v for r in aggregate_frames(df, lambda a, n: F.array_max(a) * n + F.array_min(a), ["i"], 4, empty=-1.0).collect()}
    assert got == {0: 19.0, 1: 7.0}


def test_grids(spark):
    a = {(r.gx, r.gy, r.gz): (r.x, r.y, r.z) for r in g.grid_coords(spark, GridSpec((2, 3, 4), 0.5), (0.0, 0.0, 0.0)).collect()}
    assert len(a) == 24 and a[0, 0, 0] == (-0.5, -0.75, -1.0) and a[1, 2, 3] == (0.0, 0.25, 0.5)
    b = {(r.gx, r.gy, r.gz): r.x for r in g.grid_linspace(spark, (0.0, 0.0, 0.0), (2.0, 2.0, 2.0), (3, 1, 1)).collect()}
    assert b == {(0, 0, 0): -1.0, (1, 0, 0): 0.0, (2, 0, 0): 1.0}


def test_specs():
    parent = FeatureSpec("p", cutoff=2.0, grid=GridSpec(4))
    r = FeatureSpec("f", frame_offset=3).resolved(parent)
    assert (r.padding, r.cutoff, r.frame_offset, r.by_residue, r.sigma) == (2.0, 2.0, 3, False, 1.0)
    with pytest.raises(ValueError):
        FeatureSpec("f").resolved(FeatureSpec("p"))
    with pytest.raises(ValueError):
        GridSpec((0, 1, 1))
    assert GridSpec(32, 0.5).border(0.9) == 2 and GridSpec.of_lengths(16.0, 32).spacing == 0.5
