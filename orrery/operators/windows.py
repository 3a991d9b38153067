"""Frame slices and focal points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slices(coords: DataFrame, width: int, frames: DataFrame | None = None) -> DataFrame:
    """coords with slice_id and the frame's place in the slice, slice_frame. A ragged last slice is dropped.

    frames (traj_id, n_frames) spares a pass over coords."""
    n = frames if frames is not None else coords.groupBy("traj_id").agg((F.max("frame") + 1).alias("n_frames"))
    out = coords.join(n, "traj_id").withColumn("slice_id", F.floor(F.col("frame") / width).cast("int"))
    return out.where(F.col("slice_id") < F.floor(F.col("n_frames") / width)).withColumn("slice_frame", F.col("frame") % width).drop("n_frames")


def stride(coords: DataFrame, step: int) -> DataFrame:
    """Every step-th frame, renumbered from 0."""
    return coords.where(F.col("frame") % step == 0).withColumn("frame", (F.col("frame") / step).cast("int"))


def frame_subset(coords: DataFrame, frames: list[int]) -> DataFrame:
    """Only these frames, renumbered in the given order."""
    place = F.array_position(F.array(*map(F.lit, frames)), F.col("frame")).cast("int") - 1
    return coords.where(F.col("frame").isin(frames)).withColumn("frame", place)


def _centroids(sliced: DataFrame, by: list[str]) -> DataFrame:
    return sliced.where("slice_frame = 0").groupBy(*by).agg(*(F.avg(a).alias(f"f{a}") for a in "xyz"))


def focus_of_selection(sliced: DataFrame, selected: DataFrame, focus_id: int = 0) -> DataFrame:
    """(traj_id, slice_id, focus_id, fx, fy, fz): the centroid of the selected atoms in each slice's first frame.

    A trajectory without a selected atom has none, and so no samples."""
    own = sliced.join(selected.select("traj_id", "atom_id").distinct(), ["traj_id", "atom_id"], "left_semi")
    return _centroids(own, ["traj_id", "slice_id"]).withColumn("focus_id", F.lit(focus_id))


def focus_of_indices(sliced: DataFrame, groups: list[list[int] | int]) -> DataFrame:
    """One focus for each list of atom ids."""
    sets = [[g] if isinstance(g, int) else g for g in groups]
    of = F.array(*(F.struct(F.lit(i).alias("focus_id"), F.array(*map(F.lit, s)).alias("ids")) for i, s in enumerate(sets)))
    rows = sliced.withColumn("__g", F.explode(F.filter(of, lambda g: F.array_contains(g["ids"], F.col("atom_id").cast("int"))))).withColumn("focus_id", F.col("__g.focus_id"))
    return _centroids(rows, ["traj_id", "slice_id", "focus_id"])


def focus_absolute(sliced: DataFrame, points: list[tuple[float, float, float]]) -> DataFrame:
    """The given points, in every slice."""
    of = F.array(*(F.struct(F.lit(i).alias("focus_id"), *(F.lit(float(v)).alias(f"f{a}") for a, v in zip("xyz", p))) for i, p in enumerate(points)))
    return sliced.select("traj_id", "slice_id").distinct().select("traj_id", "slice_id", F.inline(of))


def focus_of_map(sliced: DataFrame, index_map: DataFrame) -> DataFrame:
    """index_map: traj_id and atom_ids, an array. One focus for each trajectory it names."""
    atoms = index_map.select("traj_id", F.explode("atom_ids").alias("atom_id")).distinct()
    return focus_of_selection(sliced, atoms)


def tumbling(df: DataFrame, keys: list[str], order: list[str], width: int) -> DataFrame:
    """Any series cut by row number: place (from 0) and slice_id, full slices only."""
    by = Window.partitionBy(*keys)
    out = df.withColumn("place", F.row_number().over(by.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(by))
    out = out.withColumn("slice_id", F.floor(F.col("place") / width).cast("int"))
    return out.where(F.col("slice_id") < F.floor(F.col("__n") / width)).drop("__n")
