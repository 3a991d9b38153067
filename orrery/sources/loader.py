"""Lazy loading of many trajectories: a manifest table joined to coordinates and atoms."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import select_atoms


@dataclass(frozen=True)
class Loader:
    """manifest: position, traj_id, stride (null for 1). Nothing is read until a plan over frames() or atoms() runs."""

    manifest: DataFrame
    coords: DataFrame
    atom_table: DataFrame
    mask: str | None = None

    @classmethod
    def of_ids(cls, ids: DataFrame, coords: DataFrame, atoms: DataFrame, stride: int = 1, mask: str | None = None) -> Loader:
        numbered = ids.select("traj_id", F.lit(stride).alias("stride")).withColumn("position", F.row_number().over(Window.orderBy("traj_id")) - 1)
        return cls(numbered, coords, atoms, mask)

    def __getitem__(self, which: int | slice | list[int]) -> Loader:
        p = F.col("position")
        if isinstance(which, int):
            keep = p == which
        elif isinstance(which, slice):
            keep = (p >= (which.start or 0)) & ((p - (which.start or 0)) % (which.step or 1) == 0)
            keep = keep & (p < which.stop) if which.stop is not None else keep
        else:
            keep = p.isin(which)
        return replace(self, manifest=self.manifest.where(keep))

    def append(self, ids: DataFrame, stride: int = 1) -> Loader:
        """With more trajectories behind those there are."""
        n = F.coalesce(F.max("position") + 1, F.lit(0)).alias("n")
        more = ids.select("traj_id", F.lit(stride).alias("stride")).withColumn("r", F.row_number().over(Window.orderBy("traj_id")) - 1)
        moved = more.crossJoin(self.manifest.agg(n)).select("traj_id", "stride", (F.col("n") + F.col("r")).alias("position"))
        return replace(self, manifest=self.manifest.unionByName(moved))

    def atoms(self) -> DataFrame:
        own = self.atom_table.join(self.manifest.select("traj_id").distinct(), "traj_id", "left_semi")
        return select_atoms(own, self.mask) if self.mask else own

    def frames(self) -> DataFrame:
        """Coordinates with the stride applied and frames renumbered."""
        rows = self.coords.join(self.manifest.select("traj_id", "position", F.coalesce("stride", F.lit(1)).alias("stride")), "traj_id")
        rows = rows.where(F.col("frame") % F.col("stride") == 0).withColumn("frame", (F.col("frame") / F.col("stride")).cast("int")).drop("stride")
        return rows.join(self.atoms().select("traj_id", "atom_id"), ["traj_id", "atom_id"], "left_semi") if self.mask else rows
