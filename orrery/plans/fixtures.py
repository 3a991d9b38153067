"""Trajectories out of the test tables, the same in Spark and in SQL.

atoms and coords come from embeddings: 100 vectors are the atoms of a trajectory, a vector's first 63 elements its 21 frames of x, y, z on a
lattice of spacing 1. series come from events: each user's values in order of time.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import RESIDUES

FRAMES, SIDE, ATOMS = 21, 8, 100
NUMBERS = (1, 6, 7, 8, 16, 15, 9, 17, 35, 53)
NAMES = ("N", "CA", "C", "O", "CB", "HA", "CD", "OG")


def _list(values) -> str:
    return "[" + ", ".join(repr(v) for v in values) + "]"


VIEWS = f"""
v_atoms AS (SELECT vec_id // {ATOMS} AS traj_id, vec_id % {ATOMS} AS atom_id, (vec_id % {ATOMS}) // 8 AS resid, {_list(NUMBERS)}[label + 1] AS z_number,
    {_list(NAMES)}[(vec_id % {ATOMS}) % 8 + 1] AS atom_name, {_list(RESIDUES)}[((vec_id % {ATOMS}) // 8) % 20 + 1] AS resname, (2 * label - 9) / 20.0::DOUBLE AS charge FROM embeddings),
v_frames AS (SELECT unnest(range({FRAMES})) AS frame),
v_coords AS (SELECT vec_id // {ATOMS} AS traj_id, vec_id % {ATOMS} AS atom_id, frame,
    {", ".join(f"CAST(round(CAST(embedding[3 * frame + {k + 1}] AS DOUBLE) * 8 + 4) AS INTEGER) AS {a}" for k, a in enumerate("xyz"))} FROM embeddings, v_frames),
v_points AS (SELECT c.*, a.resid, a.z_number, a.atom_name, a.resname, a.charge FROM v_coords c JOIN v_atoms a USING (traj_id, atom_id)),
v_grid AS (SELECT a.i AS gx, b.i AS gy, c.i AS gz FROM (SELECT unnest(range({SIDE})) AS i) a, (SELECT unnest(range({SIDE})) AS i) b, (SELECT unnest(range({SIDE})) AS i) c),
v_series AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v, event_type FROM events)
"""


class Views:
    """The views as DataFrames, made when first asked for. Coordinates are doubles."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    _IDS = (f"cast(floor(vec_id / {ATOMS}) as bigint) as traj_id", f"cast(vec_id % {ATOMS} as int) as atom_id")
    _ATOM = (
        f"cast(floor(vec_id % {ATOMS} / 8) as int) as resid", f"element_at(array{NUMBERS}, label + 1) as z_number", f"element_at(array{NAMES}, cast(vec_id % {ATOMS} % 8 as int) + 1) as atom_name",
        f"element_at(array{tuple(RESIDUES)}, cast(floor(vec_id % {ATOMS} / 8) % 20 as int) + 1) as resname", "(2 * label - 9) / 20 as charge",
    )
    _XYZ = tuple(f"round(cast(get(embedding, 3 * frame + {k}) as double) * 8 + 4) as {a}" for k, a in enumerate("xyz"))

    @cached_property
    def atoms(self) -> DataFrame:
        return self.table("embeddings").selectExpr(*self._IDS, *self._ATOM)

    @cached_property
    def coords(self) -> DataFrame:
        rows = self.table("embeddings").selectExpr(*self._IDS, "embedding", f"explode(sequence(0, {FRAMES - 1})) as frame")
        return rows.selectExpr("traj_id", "atom_id", "frame", *self._XYZ)

    @cached_property
    def points(self) -> DataFrame:
        """coords with the atoms' columns: one scan, as both come from one table."""
        rows = self.table("embeddings").selectExpr(*self._IDS, "embedding", *self._ATOM, f"explode(sequence(0, {FRAMES - 1})) as frame")
        return rows.selectExpr("traj_id", "atom_id", "frame", *self._XYZ, "resid", "z_number", "atom_name", "resname", "charge")

    @cached_property
    def series(self) -> DataFrame:
        e = self.table("events")
        frame = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        return e.select(F.col("user_id").alias("traj_id"), frame.alias("frame"), F.col("value").alias("v"), "event_type")
