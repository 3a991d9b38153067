"""Labels of samples: affinities, conformational penalties, closest-pair distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BACKBONE, PAIR_CODE, RESIDUE_ALIAS, RESIDUE_CODE, lookup

PARTNERS = ("C", "N", "CA", "O", "CB")
__all__ = ["BACKBONE", "affinity", "closest_pairs", "distance_series", "pcdt_label", "residue_label", "rmsd", "rmsd_label", "stepping"]


def affinity(samples: DataFrame, table: DataFrame, superseded: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """samples (traj_id, ...) with the value of the first row of table (key, value, and position for 'first') of their key.

    superseded (old, new) renames keys before. strict raises for a key without a value."""
    keyed = samples.withColumn("key", F.col("traj_id"))
    if superseded is not None:
        renamed = keyed.join(superseded.select(F.col("old").alias("key"), "new"), "key", "left")
        keyed = renamed.withColumn("key", F.coalesce("new", "key")).drop("new")
    first = table.groupBy("key").agg(F.min_by("value", "position").alias("value"))
    out = keyed.join(first, "key", "left")
    if not strict:
        return out
    missing = F.raise_error(F.concat(F.lit("no label for "), F.col("key").cast("string"))).cast("double")
    return out.withColumn("value", F.coalesce("value", missing))


def stepping(value: str = "value"):
    """Half the value, rounded down, at most 5."""
    return F.least(F.floor(F.col(value) / 2), F.lit(5)).cast("double")


def rmsd(coords: DataFrame) -> DataFrame:
    """(traj_id, frame, rmsd): to frame 0, without a fit."""
    first = coords.where("frame = 0").select("traj_id", "atom_id", *(F.col(a).alias(f"{a}0") for a in "xyz"))
    d2 = sum(((F.col(a) - F.col(f"{a}0")) * (F.col(a) - F.col(f"{a}0")) for a in "yz"), (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")))
    return coords.join(first, ["traj_id", "atom_id"]).groupBy("traj_id", "frame").agg(F.sqrt(F.avg(d2)).alias("rmsd"))


def rmsd_label(coords: DataFrame, base: DataFrame, width: int, most: float = 8.0) -> DataFrame:
    """(traj_id, slice_id, label): base less a tenth of the slice's mean relative deviation, each at most `most`."""
    from .windows import slices

    cut = slices(rmsd(coords), width)
    mean = cut.groupBy("traj_id", "slice_id").agg(F.avg(F.least(F.col("rmsd"), F.lit(most))).alias("m"))
    return mean.join(base, "traj_id").select("traj_id", "slice_id", (F.col("value") * (1 - 0.1 * F.col("m") / most)).alias("label"))


def nearest(p: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each point of p the id of the nearest of q, the lowest of equals: cells of about one point, searched ring by ring until none can be nearer."""
    low, size = q.min(axis=0), np.ptp(q, axis=0)
    wide = size[size > 1e-6 * size.max()]
    h = float(np.prod(wide) / len(q)) ** (1 / len(wide)) if len(wide) else 1.0
    dims = np.floor(size / h).astype(np.int64) + 1
    key = lambda c: (c[..., 0] * dims[1] + c[..., 1]) * dims[2] + c[..., 2]
    own = np.floor((q - low) / h).astype(np.int64)
    by = np.lexsort((ids, key(own)))
    keys, q, ids = key(own)[by], q[by], ids[by]
    # a point outside is searched for from where it is nearest to the box of q: what lies r from there is further than r from the point
    near = np.clip(p, low, low + size)
    away = ((p - near) ** 2).sum(axis=1)
    cell = np.minimum(np.floor((near - low) / h).astype(np.int64), dims - 1)
    best, partner, left, ring = np.full(len(p), np.inf), np.full(len(p), -1, ids.dtype), np.arange(len(p)), 0
    while len(left) and ring < dims.max():
        shell = np.stack(np.meshgrid(*(np.arange(-min(ring, d - 1), min(ring, d - 1) + 1) for d in dims.tolist()), indexing="ij"), axis=-1).reshape(-1, 3)
        shell = shell[np.abs(shell).max(axis=1) == ring]
        for some in np.array_split(left, 1 + len(left) * len(shell) // (1 << 20)):
            at = cell[some][:, None] + shell[None]
            inside = ((at >= 0) & (at < dims)).all(axis=2)
            i, j = np.nonzero(inside)
            k = key(at[i, j])
            a, z = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
            i = np.repeat(some[i], z - a)
            c = np.repeat(a, z - a) + np.arange(len(i)) - np.repeat(np.cumsum(z - a) - (z - a), z - a)
            d2 = ((p[i] - q[c]) ** 2)
            d2 = d2[:, 0] + d2[:, 1] + d2[:, 2]
            o = np.lexsort((ids[c], d2, i))
            i, c, d2 = i[o], c[o], d2[o]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
            i, c, d2 = i[first], c[first], d2[first]
            nearer = (d2 < best[i]) | (d2 == best[i]) & (ids[c] < partner[i])
            best[i[nearer]], partner[i[nearer]] = d2[nearer], ids[c[nearer]]
        left = left[~(best[left] < (away[left] + (ring * h) ** 2) * (1 - 1e-9))]
        ring += 1
    return partner


def closest_pairs(coords: DataFrame, selected: DataFrame, counterpart: DataFrame) -> DataFrame:
    """(traj_id, atom_id, partner_id): for each selected atom its nearest counterpart in frame 0, the lowest id of equals.

    A trajectory's atoms of one frame meet in numpy, so that no table of all pairs is made."""
    first = coords.where("frame = 0").select("traj_id", "atom_id", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    for name, x in (("__a", selected), ("__b", counterpart)):
        first = first.join(x.select("traj_id", "atom_id", F.lit(True).alias(name)).distinct(), ["traj_id", "atom_id"], "left")
    schema = first.select("traj_id", "atom_id", F.col("atom_id").alias("partner_id")).schema

    def paired(table: pa.Table) -> pa.Table:
        p, q = (table.filter(table.column(c).is_valid()) for c in ("__a", "__b"))
        if not q.num_rows:
            p = p.slice(0, 0)
        points = lambda t: np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
        partner = nearest(points(p), points(q), q.column("atom_id").to_numpy()) if p.num_rows else []
        return pa.table({"traj_id": p.column("traj_id"), "atom_id": p.column("atom_id"), "partner_id": pa.array(partner, p.schema.field("atom_id").type)})

    return first.where("__a or __b").groupBy("traj_id").applyInArrow(paired, schema)


def distance_series(coords: DataFrame, pairs: DataFrame) -> DataFrame:
    """(traj_id, atom_id, frame, distance) of each pair over all frames."""
    a = coords.select("traj_id", "atom_id", "frame", "x", "y", "z").join(pairs, ["traj_id", "atom_id"])
    b = coords.select("traj_id", F.col("atom_id").alias("partner_id"), "frame", *(F.col(c).alias(f"{c}p") for c in "xyz"))
    d2 = sum(((F.col(c) - F.col(f"{c}p")) * (F.col(c) - F.col(f"{c}p")) for c in "yz"), (F.col("x") - F.col("xp")) * (F.col("x") - F.col("xp")))
    return a.join(b, ["traj_id", "partner_id", "frame"]).select("traj_id", "atom_id", "frame", F.sqrt(d2).alias("distance"))


def pcdt_label(series: DataFrame, base: DataFrame, width: int, cutoff: float | None = None) -> DataFrame:
    """(traj_id, slice_id, label): base less a tenth of the mean z-score of the slice's distances against the trajectory's."""
    from .windows import slices

    d = series.withColumn("distance", F.least("distance", F.lit(float(cutoff)))) if cutoff is not None else series
    whole = d.groupBy("traj_id", "atom_id").agg(F.avg("distance").alias("m0"), F.stddev_pop("distance").alias("s0"))
    flat = F.lit(float(cutoff) if cutoff is not None else 6.0)
    part = slices(d, width).groupBy("traj_id", "slice_id", "atom_id").agg(F.avg("distance").alias("m1"))
    z = (F.col("m0") - F.col("m1")) / F.when(F.col("s0") == 0, flat).otherwise(F.col("s0"))
    mean = part.join(whole, ["traj_id", "atom_id"]).groupBy("traj_id", "slice_id").agg(F.avg(z).alias("z"))
    return mean.join(base, "traj_id").select("traj_id", "slice_id", (F.col("value") * (1 - 0.1 * F.abs("z"))).alias("label"))


def residue_label(name: str, second: str | None = None):
    """Class of a residue, or of an ordered pair, after protonation variants are mapped; null if there is none."""
    plain = lambda c: lookup(F.col(c), RESIDUE_ALIAS, F.col(c))
    return lookup(plain(name), RESIDUE_CODE) if second is None else lookup(F.concat(plain(name), plain(second)), PAIR_CODE)
