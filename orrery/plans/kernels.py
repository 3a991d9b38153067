"""Queries of the grid kernels: stencils, observables, densities, frame aggregates."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators.framewise import AGGREGATES, aggregate_frames, summation
from ..operators.observables import OBSERVABLES, empty_value, observe
from ..spec import GridSpec
from .fixtures import FRAMES, SIDE
from .registry import add, query

GRID = GridSpec(SIDE, 1.0)
CELLS = "gx:i gy:i gz:i"
#: Cutoffs: pairs within a cell's sphere grow with its sixth power.
CUTOFF = dict.fromkeys(OBSERVABLES, 3.0) | {"dispersion": 1.5}
SIGMA, REACH = 1.0, 2.0

_D2 = "(x - gx) * (x - gx) + (y - gy) * (y - gy) + (z - gz) * (z - gz)"
_EACH = {
    "existence": "1.0", "direct_count": "count(*)", "distinct_count": "count(DISTINCT w)", "mean_distance": "sum(sqrt(d2) * w) / sum(w)", "cumulative_weight": "sum(w)", "density": f"sum(w) / (4.0 / 3 * {pi!r} * {{c}} * {{c}} * {{c}})",
    "eccentricity": "sqrt((sum(w * x) / sum(w) - any_value(gx)) ** 2 + (sum(w * y) / sum(w) - any_value(gy)) ** 2 + (sum(w * z) / sum(w) - any_value(gz)) ** 2)",
}
_FRAMES = {"mean": "avg(v)", "std": "stddev_pop(v)", "median": "median(v)", "var": "var_pop(v)", "max": "max(v)", "min": "min(v)", "drift": "regr_slope(v, frame)"}


def _near(cutoff: float) -> str:
    return f"near AS (SELECT traj_id, frame, atom_id, gx, gy, gz, x, y, z, CAST(z_number AS DOUBLE) AS w, {_D2} AS d2 FROM v_points, v_grid WHERE {_D2} <= {cutoff * cutoff})"


def _per(kind: str) -> str:
    """Common table expressions up to per: traj_id, frame, cell, v."""
    c = CUTOFF[kind]
    by = "traj_id, frame, gx, gy, gz"
    if kind == "dispersion":
        pair = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
        return f"""{_near(c)},
        pairs AS (SELECT a.traj_id, a.frame, a.gx, a.gy, a.gz, sum(a.w * b.w * {pair}) / sum(a.w * b.w) AS v FROM near a JOIN near b ON a.traj_id = b.traj_id AND a.frame = b.frame AND a.gx = b.gx AND a.gy = b.gy AND a.gz = b.gz AND a.atom_id < b.atom_id GROUP BY ALL),
        seen AS (SELECT DISTINCT {by} FROM near), per AS (SELECT seen.*, coalesce(pairs.v, 0) AS v FROM seen LEFT JOIN pairs USING ({by}))"""
    if kind == "radius_of_gyration":
        return f"""{_near(c)},
        com AS (SELECT {by}, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * z) / sum(w) AS cz, count(*) AS n FROM near GROUP BY ALL),
        per AS (SELECT {by}, CASE WHEN any_value(n) = 1 THEN 0 ELSE sqrt(sum(w * ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) / sum(w)) END AS v FROM near JOIN com USING ({by}) GROUP BY ALL)"""
    return f"{_near(c)}, per AS (SELECT {by}, CAST({_EACH[kind].format(c=c)} AS DOUBLE) AS v FROM near GROUP BY ALL)"


def _framewise(agg: str, per: str, empty: float, keys: str = "traj_id, gx, gy, gz", frames: str = f"{FRAMES}") -> str:
    """per made dense, then aggregated."""
    dense = f"""{per}, dense AS (SELECT {", ".join("c." + k for k in keys.split(", "))}, f.frame, coalesce(p.v, {empty}) AS v FROM (SELECT DISTINCT {keys} FROM per) c CROSS JOIN v_frames f
        LEFT JOIN per p ON {" AND ".join(f"c.{k} = p.{k}" for k in keys.split(", "))} AND f.frame = p.frame)"""
    if agg != "entropy":
        return f"{dense}\n--\nSELECT {keys}, {_FRAMES[agg]} AS v FROM dense GROUP BY ALL"
    return dense + _entropy(keys, "dense", frames)


def _entropy(keys: str, source: str, n: str) -> str:
    return f""", ends AS (SELECT *, min(v) OVER (PARTITION BY {keys}) AS lo, max(v) OVER (PARTITION BY {keys}) AS hi FROM {source}),
        bins AS (SELECT {keys}, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 16), 15) END AS bin, count(*) AS k, {n} AS n FROM ends GROUP BY ALL)
--
SELECT {keys}, -sum(k::DOUBLE / n * log2(k::DOUBLE / n)) AS v FROM bins GROUP BY ALL"""


def _observe(v, kind: str):
    rows = v.points.withColumn("w", F.col("z_number").cast("double"))
    return observe(rows, GRID, kind, CUTOFF[kind], ["traj_id", "frame"], on_lattice=True)


def _observables() -> None:
    crosses = [(k, "mean", f"mo_{k}") for k in OBSERVABLES]
    crosses += [("direct_count", a, f"mo_direct_count_{a}") for a in AGGREGATES]
    crosses += [("eccentricity", a, f"mo_eccentricity_{a}") for a in ("median", "max", "min", "std")] + [("cumulative_weight", "drift", "mo_cumulative_weight_drift"), ("existence", "entropy", "mo_existence_entropy")]
    for kind, agg, name in crosses:
        empty = empty_value(kind, CUTOFF[kind])
        make = lambda v, kind=kind, agg=agg, empty=empty: aggregate_frames(_observe(v, kind), agg, ["traj_id", *g.CELL], FRAMES, empty=empty)
        add(name, f"traj_id:i {CELLS} v:d", make, _framewise(agg, _per(kind), empty))


_observables()

_LATTICE = range(-GRID.border(REACH), SIDE + GRID.border(REACH))
_SMEAR = f"""
line AS (SELECT unnest(range({_LATTICE.start}, {_LATTICE.stop})) AS i),
wide AS (SELECT {{keys}}, atom_id, CAST(z_number AS DOUBLE) AS w, a.i AS gx, b.i AS gy, c.i AS gz, (x - a.i) ** 2 + (y - b.i) ** 2 + (z - c.i) ** 2 AS d2 FROM {{source}}
    JOIN line a ON abs(x - a.i) < {REACH} JOIN line b ON abs(y - b.i) < {REACH} JOIN line c ON abs(z - c.i) < {REACH}),
ball AS (SELECT *, exp(-d2 / {2 * SIGMA * SIGMA}) / {SIGMA * (2 * pi) ** 0.5!r} AS g FROM wide WHERE d2 < {REACH * REACH}),
share AS (SELECT *, w * g / sum(g) OVER (PARTITION BY {{keys}}, atom_id) AS part FROM ball),
per AS (SELECT {{keys}}, gx, gy, gz, {{v}} AS v FROM share WHERE gx BETWEEN 0 AND {SIDE - 1} AND gy BETWEEN 0 AND {SIDE - 1} AND gz BETWEEN 0 AND {SIDE - 1} GROUP BY ALL)"""


def _density(v):
    rows = v.points.withColumn("w", F.col("z_number").cast("double"))
    return g.voxelize(rows, GRID, REACH, SIGMA, ["traj_id", "frame"], on_lattice=True)


def _densities() -> None:
    for agg in AGGREGATES:
        # bins of sums that differ in their last bit could differ; six places don't
        exact = agg == "entropy"
        make = lambda v, agg=agg, exact=exact: aggregate_frames(_density(v).withColumn("v", F.round("v", 6) if exact else F.col("v")), agg, ["traj_id", *g.CELL], FRAMES)
        add(f"pdf_{agg}", f"traj_id:i {CELLS} v:d", make, _framewise(agg, _SMEAR.format(keys="traj_id, frame", source="v_points", v="round(sum(part), 6)" if exact else "sum(part)"), 0.0))


_densities()


@query(f"traj_id:i {CELLS} v:d", _SMEAR.format(keys="traj_id", source="(SELECT * FROM v_points WHERE frame = 0) AS p", v="sum(part)") + "\n--\nSELECT * FROM per")
def voxel_static(v):
    rows = v.points.where("frame = 0").withColumn("w", F.col("z_number").cast("double"))
    return g.voxelize(rows, GRID, REACH, SIGMA, ["traj_id"], on_lattice=True)


@query("traj_id:i total:d", _SMEAR.format(keys="traj_id", source="(SELECT * FROM v_points WHERE frame = 0) AS p", v="sum(part)") + "\n--\nSELECT traj_id, sum(v) AS total FROM per GROUP BY ALL")
def voxel_mass(v):
    """What of each trajectory's weight stays in the grid."""
    return voxel_static(v).groupBy("traj_id").agg(F.sum("v").alias("total"))


@query(f"traj_id:i frame:i {CELLS} v:d", _per("cumulative_weight") + "\n--\nSELECT * FROM per WHERE frame = 4")
def frame_observation(v):
    rows = v.points.where("frame = 4").withColumn("w", F.col("z_number").cast("double"))
    return observe(rows, GRID, "cumulative_weight", 3.0, ["traj_id", "frame"], on_lattice=True)


for _name, _inclusive in (("stencil_lt", False), ("stencil_le", True)):
    add(
        _name, f"{CELLS} n:i",
        lambda v, inclusive=_inclusive: g.near_cells(v.coords.where("frame = 0"), GRID, 2.0, inclusive, on_lattice=True).groupBy(*g.CELL).agg(F.count("*").alias("n")),
        f"SELECT gx, gy, gz, count(*) AS n FROM v_coords, v_grid WHERE frame = 0 AND {_D2} {'<=' if _inclusive else '<'} 4 GROUP BY ALL",
    )


@query(f"traj_id:i {CELLS} n:i", "SELECT traj_id, gx, gy, gz, count(*) AS n FROM (SELECT traj_id, x / 2.0 + 0.25 AS x, y / 2.0 + 0.25 AS y, z / 2.0 + 0.25 AS z FROM v_coords WHERE frame < 3) c, v_grid WHERE " + _D2 + " <= 2.25 GROUP BY ALL")
def stencil_off_lattice(v):
    rows = v.coords.where("frame < 3").select("traj_id", *((F.col(a) / 2 + 0.25).alias(a) for a in "xyz"))
    return g.near_cells(rows, GRID, 1.5).groupBy("traj_id", *g.CELL).agg(F.count("*").alias("n"))


@query(f"traj_id:i frame:i {CELLS} v:d", "SELECT traj_id, frame, floor(x / 2.0) AS gx, floor(y / 2.0) AS gy, floor(z / 2.0) AS gz, sum(charge) AS v FROM v_points WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 7 GROUP BY ALL")
def discretize(v):
    return g.discretize(v.points, GridSpec(4, 2.0), ["traj_id", "frame"], "charge")


@query("traj_id:i atom_id:i x:d y:d z:d", "SELECT traj_id, atom_id, x - avg(x) OVER w + 4 AS x, y - avg(y) OVER w + 4 AS y, z - avg(z) OVER w + 4 AS z FROM v_coords WHERE frame = 0 WINDOW w AS (PARTITION BY traj_id)")
def translate_cog(v):
    return g.translate_to_centroid(v.coords.where("frame = 0"), GRID, ["traj_id"])


@query(f"{CELLS} x:d y:d z:d", "SELECT gx, gy, gz, gx * 0.5 + 1.0 - 2.0 AS x, gy * 0.5 + 2.0 - 2.0 AS y, gz * 0.5 + 3.0 - 2.0 AS z FROM v_grid")
def grid_coords(v):
    return g.grid_coords(v.spark, GridSpec.of_lengths(4.0, SIDE), (1.0, 2.0, 3.0))


@query(f"{CELLS} x:d y:d z:d", "SELECT gx, gy, gz, 1.0 - 3.5 + gx * (7.0 / 7) AS x, 2.0 - 3.5 + gy * (7.0 / 7) AS y, 3.0 - 1.75 + gz * (3.5 / 7) AS z FROM v_grid")
def grid_coords_linspace(v):
    return g.grid_linspace(v.spark, (1.0, 2.0, 3.0), (7.0, 7.0, 3.5), (SIDE,) * 3)


# a series of which only purchases and clicks have a row; the other places count as 0 (the factor's digits keep values off the halves between two roundings)
_SERIES = "dense AS (SELECT traj_id, frame, CASE WHEN event_type IN ('purchase', 'click') THEN v * 0.6180339 ELSE 0 END AS v, count(*) OVER (PARTITION BY traj_id) AS n FROM v_series)"
_SOME = ", chosen AS (SELECT dense.* FROM dense WHERE traj_id IN (SELECT traj_id FROM v_series WHERE event_type IN ('purchase', 'click')))"


def _series(v):
    from pyspark.sql import Window

    rows = v.series.withColumn("n", F.count("*").over(Window.partitionBy("traj_id")))
    return rows.where(F.col("event_type").isin("purchase", "click")).withColumn("v", F.col("v") * 0.6180339)


for _agg in AGGREGATES:
    add(
        f"agg_{_agg}", "traj_id:i v:d",
        lambda v, agg=_agg: aggregate_frames(_series(v), agg, ["traj_id"], F.col("n")),
        (_SERIES + _SOME + f"\n--\nSELECT traj_id, coalesce({_FRAMES[_agg]}, 0) AS v FROM chosen GROUP BY ALL") if _agg != "entropy" else _SERIES + _SOME + _entropy("traj_id", "chosen", "any_value(n)"),
    )


add("summation", "v:d", lambda v: summation(v.series), "SELECT sum(CAST(value AS DOUBLE)) AS v FROM events")
