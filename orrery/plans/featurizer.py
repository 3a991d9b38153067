"""From trajectories to features: one lazy plan for all trajectories, slices, foci and features.

Features that need the same crop share it: the planner groups them by (grid, padding, by_residue, selection), so coordinates are sliced, moved to
the focus and cropped once a group, and its observables of one cutoff come from one stencil and one grouping. All later exchanges are on the sample and cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BACKBONE, ELEMENTS, lookup
from ..functions.masks import condition, has_distance, parse, select_atoms
from ..functions.scalar import element_property
from ..operators import grid as g
from ..operators.framewise import PLAIN, aggregate_frames, plain
from ..operators.observables import OBSERVABLES, empty_value, observe, observed_together
from ..operators.windows import slices
from ..spec import SLICE_KEYS, FeatureSpec

#: Observables that several features of one crop compute in one grouping.
TOGETHER = frozenset(OBSERVABLES) - {"dispersion"}


def _flag(c: Column, reverse: bool = False) -> Column:
    return F.when(~c if reverse else c, 1.0).otherwise(0.0)


def charge_sign(charge: Column, kind: str) -> Column:
    """'positive' and 'negative' keep that side and put 0 for the other, 'both' keeps all."""
    zero = F.lit(0.0)
    return {"positive": F.greatest(charge, zero), "negative": F.least(charge, zero), "both": charge}[kind]


#: Weights by name: options to a Column over atoms (atom_id, resid, z_number, atom_name, charge, and flags such as aromatic where given).
WEIGHTS: dict[str, Callable[..., Column]] = {
    "uniform": lambda value=1.0: F.lit(float(value)),
    "atom_id": lambda: F.col("atom_id").cast("double"),
    "residue_id": lambda: F.col("resid").cast("double"),
    "atomic_number": lambda: F.col("z_number").cast("double"),
    "mass": lambda: element_property(F.col("z_number"), "mass"),
    "heavy": lambda value=1.0: F.when(F.col("z_number") > 1, float(value)).otherwise(0.0),
    "radius": lambda: element_property(F.col("z_number"), "vdw_radius"),
    "electronegativity": lambda: element_property(F.col("z_number"), "electronegativity"),
    "hydrophobicity": lambda: F.abs(element_property(F.col("z_number"), "electronegativity") - ELEMENTS[6]["electronegativity"]),
    "backbone": lambda reverse=False: _flag(F.col("atom_name").isin(*BACKBONE), reverse),
    "sidechain": lambda: _flag(F.col("atom_name").isin(*BACKBONE), True),
    "atom_type": lambda element=6: _flag(F.col("z_number") == element),
    "selection": lambda mask, value=1.0: F.when(condition(mask), float(value)).otherwise(0.0),
    "charge": lambda keep="both": charge_sign(F.coalesce(F.col("charge").cast("double"), F.lit(0.0)), keep),
    "manual_charge": lambda charges, keep="both": charge_sign(lookup(F.col("atom_id").cast("int"), dict(charges), F.lit(0.0)), keep),
    # perceived properties come with the atoms, as boolean or numeric columns
    "aromatic": lambda reverse=False: _flag(F.col("aromatic"), reverse),
    "ring": lambda reverse=False: _flag(F.col("ring"), reverse),
    "donor": lambda: _flag(F.col("donor")),
    "acceptor": lambda: _flag(F.col("acceptor")),
    "hybridization": lambda: F.col("hybridization").cast("double"),
}


@dataclass
class Featurizer:
    """defaults are inherited by the features. custom weights and frame functions may be registered under names of their own."""

    defaults: FeatureSpec
    frame_width: int = 1
    specs: list[FeatureSpec] = field(default_factory=list)
    weights: dict[str, Callable[..., Column]] = field(default_factory=lambda: dict(WEIGHTS))
    #: Kernels of one's own by name: (points with x, y, z and w, the feature, its keys with the frame among them) to keys, gx, gy, gz and v.
    kernels: dict[str, Callable[[DataFrame, FeatureSpec, list[str]], DataFrame]] = field(default_factory=dict)

    def register(self, *specs: FeatureSpec) -> Featurizer:
        for s in specs:
            r = s.resolved(self.defaults)
            if any(x.outkey == r.outkey for x in self.specs):
                raise ValueError(f"outkey {r.outkey!r} is taken")
            if r.weight not in self.weights:
                raise ValueError(f"no weight {r.weight!r}")
            self.specs.append(r)
        return self

    def run(self, coords: DataFrame, atoms: DataFrame, foci: Callable[[DataFrame], DataFrame] | DataFrame, frames: DataFrame | None = None) -> DataFrame:
        """outkey, traj_id, slice_id, focus_id, gx, gy, gz, v: the cells of all features that aren't 0 throughout.

        foci: a table, or a function of the sliced coordinates that gives one. frames (traj_id, n_frames), as a manifest has it, spares
        passes over the coordinates."""
        if not self.specs:
            raise ValueError("no feature is registered")
        sliced = slices(coords, self.frame_width, frames)
        return self._run(sliced, foci(sliced) if callable(foci) else foci, ["traj_id", "slice_id"], coords, atoms)

    def _run(self, sliced: DataFrame, at: DataFrame, on: list[str], coords: DataFrame, atoms: DataFrame) -> DataFrame:
        shared: dict[tuple, list[FeatureSpec]] = {}
        for s in self.specs:
            shared.setdefault((s.grid, s.padding, s.by_residue, s.selection), []).append(s)
        out = None
        for (grid, padding, by_residue, selection), specs in shared.items():
            moved = g.translate(sliced.join(at, on), grid).drop("fx", "fy", "fz")
            atoms_ = atoms
            if selection is not None:
                atoms_ = self._selected(atoms, coords, selection)
            if by_residue and "resid" not in moved.columns:
                moved = moved.join(atoms.select("traj_id", "atom_id", "resid"), ["traj_id", "atom_id"])
            cropped = g.crop(moved, grid, padding, by_residue, (*SLICE_KEYS, "frame"))
            keep = [*SLICE_KEYS, "slice_frame", "atom_id", *g.AXES]
            own = atoms_.select("traj_id", "atom_id", *(self.weights[s.weight](**dict(s.options)).alias(f"w_{s.outkey}") for s in specs))
            points = g.spread_out(cropped.select(*keep).join(own, ["traj_id", "atom_id"]), ["traj_id", "slice_id", "slice_frame"])
            together: dict[float, list[FeatureSpec]] = {}
            for s in specs:
                if s.kernel in TOGETHER and s.kernel not in self.kernels:
                    together.setdefault(s.cutoff, []).append(s)
                    continue
                rows = self._feature(points.withColumn("w", F.col(f"w_{s.outkey}")), s).select(F.lit(s.outkey).alias("outkey"), *SLICE_KEYS, *g.CELL, "v")
                out = rows if out is None else out.unionByName(rows)
            for cutoff, own_specs in together.items():
                rows = self._observables(points, grid, cutoff, own_specs)
                out = rows if out is None else out.unionByName(rows)
        return out

    def _observables(self, points: DataFrame, grid, cutoff: float, specs: list[FeatureSpec]) -> DataFrame:
        """Observables of one crop and cutoff: one stencil and one grouping by frame and cell for all of them, and one over the frames for all
        whose aggregate is plain. The others part from there by how they are aggregated."""
        by_frame, by_cell = [*SLICE_KEYS, "slice_frame"], [*SLICE_KEYS, *g.CELL]
        near = g.near_cells(points.select(*by_frame, *g.AXES, *(f"w_{s.outkey}" for s in specs)), grid, cutoff)
        wide = observed_together(near, [(f"v_{i}", s.kernel, f"w_{s.outkey}") for i, s in enumerate(specs)], cutoff, grid.spacing, by_frame)
        out, n = None, F.lit(float(self.frame_width))
        easy = [(i, s) for i, s in enumerate(specs) if s.frame_agg in PLAIN]
        if easy:
            values = [plain(s.frame_agg, F.col(f"v_{i}").cast("double"), F.col("slice_frame").cast("double"), n, empty_value(s.kernel, cutoff)).alias(f"v_{i}") for i, s in easy]
            named = [F.struct(F.lit(s.outkey).alias("outkey"), F.col(f"v_{i}").alias("v")) for i, s in easy]
            out = wide.groupBy(*by_cell).agg(*values).select(*by_cell, F.inline(F.array(*named))).select("outkey", *by_cell, "v")
        for how in dict.fromkeys((s.frame_agg, empty_value(s.kernel, cutoff)) for s in specs if s.frame_agg not in PLAIN):
            named = [F.struct(F.lit(s.outkey).alias("outkey"), F.col(f"v_{i}").alias("v")) for i, s in enumerate(specs) if (s.frame_agg, empty_value(s.kernel, cutoff)) == how]
            long = wide.select(*by_frame, *g.CELL, F.inline(F.array(*named)))
            rows = aggregate_frames(long, how[0], ["outkey", *by_cell], self.frame_width, "slice_frame", "v", how[1]).select("outkey", *by_cell, "v")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _selected(self, atoms: DataFrame, coords: DataFrame, selection) -> DataFrame:
        if isinstance(selection, str):
            if has_distance(parse(selection)) and "x" not in atoms.columns:
                first = coords.where("frame = 0").select("traj_id", "atom_id", *g.AXES)
                return select_atoms(atoms.join(first, ["traj_id", "atom_id"]), selection)
            return select_atoms(atoms, selection)
        return atoms.where(F.col("atom_id").isin(*selection))

    def _feature(self, points: DataFrame, s: FeatureSpec) -> DataFrame:
        keys = list(SLICE_KEYS)
        if s.kernel == "static":
            return g.voxelize(points.where(F.col("slice_frame") == s.frame_offset), s.grid, s.cutoff, s.sigma, keys)
        by_frame = [*keys, "slice_frame"]
        if s.kernel in self.kernels:
            rows, empty = self.kernels[s.kernel](points, s, by_frame), 0.0
        elif s.kernel == "density":
            rows, empty = g.voxelize(points, s.grid, s.cutoff, s.sigma, by_frame), 0.0
        else:
            rows, empty = observe(points, s.grid, s.kernel, s.cutoff, by_frame), empty_value(s.kernel, s.cutoff)
        return aggregate_frames(rows, s.frame_agg, [*keys, *g.CELL], self.frame_width, "slice_frame", "v", empty)

    def run_by_residue(self, coords: DataFrame, atoms: DataFrame, most: int | None = None) -> DataFrame:
        """run() with a focus at each residue's centroid (focus_id is the residue) on that residue's atoms alone, at most `most` a name."""
        from ..operators.residues import blocks

        chosen = blocks(atoms, None, most).select("traj_id", "resid")
        own = atoms.join(chosen, ["traj_id", "resid"], "left_semi")
        sliced = slices(coords.join(own.select("traj_id", "atom_id", "resid"), ["traj_id", "atom_id"]), self.frame_width)
        foci = sliced.where("slice_frame = 0").groupBy("traj_id", "slice_id", F.col("resid").alias("focus_id")).agg(*(F.avg(a).alias(f"f{a}") for a in "xyz"))
        return self._run(sliced, foci.withColumn("resid", F.col("focus_id")), ["traj_id", "slice_id", "resid"], coords, own)


def dense(features: DataFrame, dims: tuple[int, int, int], keys: list[str]) -> DataFrame:
    """keys and voxels, an array of floats in order of gx, gy, gz, with 0 for cells without a row: for the sink alone."""
    n = dims[0] * dims[1] * dims[2]
    at = (F.col("gx") * dims[1] + F.col("gy")) * dims[2] + F.col("gz")
    rows = features.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), F.col("v").cast("float")))).alias("m"))
    return rows.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0).cast("float"))).alias("voxels"))
