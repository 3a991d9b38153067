"""Residues, contacts and clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import element_property

PEPTIDE_BOND = 1.32 * 1.25


def _d2(other: str = "b") -> Column:
    return sum(((F.col(a) - F.col(f"{other}{a}")) * (F.col(a) - F.col(f"{other}{a}")) for a in "yz"), (F.col("x") - F.col(f"{other}x")) * (F.col("x") - F.col(f"{other}x")))


def blocks(atoms: DataFrame, name: str | None = None, most: int | None = None) -> DataFrame:
    """(traj_id, resid, resname, first_atom, end_atom, n_atoms) of residues of a name (all without one), the first `most` of each name."""
    rows = atoms if name is None else atoms.where(F.col("resname") == name)
    out = rows.groupBy("traj_id", "resid", "resname").agg(F.min("atom_id").alias("first_atom"), (F.max("atom_id") + 1).alias("end_atom"), F.count("*").alias("n_atoms"))
    if most is not None:
        by = Window.partitionBy("traj_id", "resname").orderBy("resid")
        out = out.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= most).drop("rn")
    return out


def bonded_pairs(atoms: DataFrame, limit: float = PEPTIDE_BOND) -> DataFrame:
    """(traj_id, resid, next_resid, bond) of consecutive residues whose single C and single N are at most limit apart. atoms has x, y, z."""
    one = lambda name, alias: F.when(F.count(F.when(F.col("atom_name") == name, 1)) == 1, F.first(F.when(F.col("atom_name") == name, F.struct("x", "y", "z")), ignorenulls=True)).alias(alias)
    residues = atoms.groupBy("traj_id", "resid").agg(one("C", "c"), one("N", "n"))
    by = Window.partitionBy("traj_id").orderBy("resid")
    pairs = residues.select("traj_id", "resid", "c", F.lead("resid").over(by).alias("next_resid"), F.lead("n").over(by).alias("n"))
    d = [F.col(f"c.{a}") - F.col(f"n.{a}") for a in "xyz"]
    return pairs.withColumn("bond", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("bond") <= limit).select("traj_id", "resid", "next_resid", "bond")


def _celled(points: DataFrame, radius: float) -> DataFrame:
    return points.withColumns({f"k{a}": F.floor(F.col(a) / F.lit(radius)).cast("int") for a in "xyz"})


def pairs_within(a: DataFrame, b: DataFrame, radius: float, keys: list[str], columns: list[str], strict: bool = False) -> DataFrame:
    """Each row of a with each row of b of the same keys within radius: a's columns, b's as b<column>, and d2.

    An equi-join on cells of the radius's size; b is copied to the 27 cells around its own."""
    left = _celled(a.select(*keys, *columns, "x", "y", "z"), radius)
    right = _celled(b.select(*keys, *columns, "x", "y", "z"), radius)
    right = right.select(*keys, *(F.col(c).alias(f"b{c}") for c in [*columns, "x", "y", "z"]), "kx", "ky", "kz")
    for c in "xyz":
        right = right.withColumn(f"k{c}", F.explode(F.sequence(F.col(f"k{c}") - 1, F.col(f"k{c}") + 1)))
    met = left.join(right, [*keys, "kx", "ky", "kz"]).withColumn("d2", _d2())
    return met.where(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius).drop("kx", "ky", "kz", "bx", "by", "bz")


def contact_counts(atoms: DataFrame, interest: DataFrame, radius: float, ours: list[int], theirs: list[int]) -> DataFrame:
    """(traj_id, n_<theirs>_<ours> ...): contacts of the atoms of interest with all others, by the elements of the two."""
    ids = ["traj_id", "atom_id"]
    chosen = interest.select(*ids).distinct()
    a = atoms.join(chosen, ids, "left_semi").where(F.col("z_number").isin(ours))
    b = atoms.join(chosen, ids, "left_anti").where(F.col("z_number").isin(theirs))
    met = pairs_within(a, b, radius, ["traj_id"], ["z_number"])
    pair = F.concat_ws("_", F.lit("n"), "bz_number", "z_number")
    counted = met.withColumn("__p", pair).groupBy("traj_id").pivot("__p", [f"n_{p}_{q}" for p in theirs for q in ours])
    counts = counted.agg(F.count(F.lit(1))).na.fill(0)
    return atoms.select("traj_id").distinct().join(counts, "traj_id", "left").na.fill(0)


def clash_counts(atoms: DataFrame, bonded: DataFrame, limit: float = 5.9) -> DataFrame:
    """(traj_id, n_atoms, contacts, clashes): ordered pairs of unbonded atoms nearer than the sum of their radii + 0.4, and - 1.25.

    bonded: traj_id, atom_id, partner_id, both ways."""
    met = pairs_within(atoms.withColumn("r", element_property(F.col("z_number"), "vdw_radius")), atoms.withColumn("r", element_property(F.col("z_number"), "vdw_radius")), limit, ["traj_id"], ["atom_id", "r"])
    other = met.where("atom_id <> batom_id").join(bonded.select("traj_id", "atom_id", F.col("partner_id").alias("batom_id")), ["traj_id", "atom_id", "batom_id"], "left_anti")
    d, s = F.sqrt("d2"), F.col("r") + F.col("br")
    counts = other.groupBy("traj_id").agg(F.count(F.when(d < s + 0.4, 1)).alias("contacts"), F.count(F.when(d < s - 1.25, 1)).alias("clashes"))
    return atoms.groupBy("traj_id").agg(F.count("*").alias("n_atoms")).join(counts, "traj_id", "left").na.fill(0)


def conflict_factor() -> Column:
    """1 - clashes over contacts an atom, of a row of clash_counts(); null without contacts."""
    return 1 - (F.col("clashes") / 2) / ((F.col("contacts") / 2) / F.col("n_atoms"))


def residue_mask(atoms: DataFrame) -> DataFrame:
    """(traj_id, mask): the residues that have an atom CA or N, as :1,2,..."""
    own = atoms.where(F.col("atom_name").isin("CA", "N")).groupBy("traj_id").agg(F.sort_array(F.collect_set(F.col("resid") + 1)).alias("r"))
    return own.select("traj_id", F.concat(F.lit(":"), F.array_join(F.col("r").cast("array<string>"), ",")).alias("mask"))
