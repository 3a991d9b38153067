"""Rigid superposition of frames on a reference: the one operator that needs linear algebra, a trajectory's frame at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(moving: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two centers: (p - a) @ r + b brings moving onto fixed with the least squares."""
    a, b = moving.mean(axis=0), fixed.mean(axis=0)
    u, _, v = np.linalg.svd((moving - a).T @ (fixed - b))
    sign = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ v)) or 1.0])
    return u @ sign @ v, a, b


def superpose(coords: DataFrame, selected: DataFrame) -> DataFrame:
    """coords (traj_id, frame, atom_id, x, y, z) with each frame moved onto frame 0 by the selected atoms.

    The reference goes along as a column, so a group is one frame and trajectories of any length spread over the cluster."""
    ids = ["traj_id", "atom_id"]
    first = coords.where("frame = 0").join(selected.select(*ids).distinct(), ids, "left_semi").select(*ids, *(F.col(c).cast("double").alias(f"{c}0") for c in "xyz"))
    rows = coords.select("traj_id", "frame", "atom_id", *(F.col(c).cast("double").alias(c) for c in "xyz")).join(first, ids, "left")

    def moved(table: pa.Table) -> pa.Table:
        p = np.stack([table[c].to_numpy() for c in "xyz"], axis=1)
        q = np.stack([table[f"{c}0"].to_numpy() for c in "xyz"], axis=1).astype(float)
        own = ~np.isnan(q[:, 0])
        if own.sum() >= 3:
            r, a, b = fit(p[own], q[own])
            p = (p - a) @ r + b
        return pa.Table.from_arrays([table["traj_id"], table["frame"], table["atom_id"], *(pa.array(p[:, i]) for i in range(3))], names=["traj_id", "frame", "atom_id", "x", "y", "z"])

    types = {f: t for f, t in rows.dtypes}
    return rows.groupBy("traj_id", "frame").applyInArrow(moved, f"traj_id {types['traj_id']}, frame {types['frame']}, atom_id {types['atom_id']}, x double, y double, z double")
