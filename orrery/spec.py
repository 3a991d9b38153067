"""Immutable descriptions of grids and features, resolved once; nothing here touches data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from math import ceil, floor

SLICE_KEYS = ("traj_id", "slice_id", "focus_id")


@dataclass(frozen=True)
class GridSpec:
    """dims cells a side (one number for a cube), spacing apart; cell (i, j, k) stands at (i, j, k) * spacing."""

    dims: tuple[int, int, int] | int
    spacing: float = 1.0

    def __post_init__(self) -> None:
        d = self.dims
        object.__setattr__(self, "dims", (int(d),) * 3 if isinstance(d, (int, float)) else tuple(int(x) for x in d))
        if len(self.dims) != 3 or min(self.dims) < 1 or not self.spacing > 0:
            raise ValueError(f"a grid needs three positive dims and a positive spacing, not {d} and {self.spacing}")

    @classmethod
    def of_lengths(cls, lengths: tuple[float, float, float] | float, dims: tuple[int, int, int] | int) -> GridSpec:
        side, n = (lengths if isinstance(lengths, (int, float)) else lengths[0]), (dims if isinstance(dims, int) else dims[0])
        return cls(dims, side / n)

    @property
    def lengths(self) -> tuple[float, ...]:
        return tuple(d * self.spacing for d in self.dims)

    @property
    def center(self) -> tuple[float, ...]:
        return tuple(x / 2 for x in self.lengths)

    def border(self, cutoff: float) -> int:
        """Cells by which the lattice is extended at each side to normalise a density."""
        return int((cutoff + self.spacing) / self.spacing)

    def offsets(self, cutoff: float, inclusive: bool, on_lattice: bool = False) -> list[tuple[int, int, int]]:
        """Cell offsets from an atom's own (lower) cell that can lie within the cutoff, wherever the atom is in that cell."""
        r = cutoff / self.spacing
        near = (lambda o: abs(o)) if on_lattice else (lambda o: max(0, -o, o - 1))
        span = range(floor(-r) if on_lattice else -ceil(r), (ceil(r) if on_lattice else ceil(r) + 1) + 1)
        limit = r * r * (1 + 1e-12)
        return [(i, j, k) for i in span for j in span for k in span if (d := near(i) ** 2 + near(j) ** 2 + near(k) ** 2) <= limit and (inclusive or not on_lattice or d < r * r)]


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: a weight for each atom, an optional selection, a kernel and how frames are aggregated.

    kernel: 'static' (one frame, density), 'density' (density a frame), or an observable's name. What is None is inherited."""

    outkey: str
    weight: str = "uniform"
    kernel: str = "static"
    frame_agg: str | Callable = "mean"
    selection: str | tuple[int, ...] | None = None
    cutoff: float | None = None
    sigma: float | None = None
    padding: float | None = None
    by_residue: bool | None = None
    frame_offset: int | None = None
    grid: GridSpec | None = None
    options: tuple[tuple[str, object], ...] = ()

    def resolved(self, parent: FeatureSpec) -> FeatureSpec:
        """With the parent's values where its own are None; padding falls back to the cutoff."""
        mine = {f.name: getattr(parent, f.name) for f in fields(self) if getattr(self, f.name) is None and f.name in INHERITED}
        out = replace(self, **mine)
        if out.grid is None or out.cutoff is None:
            raise ValueError(f"{self.outkey}: no grid or cutoff, neither its own nor inherited")
        return replace(out, padding=out.cutoff if out.padding is None else out.padding, frame_offset=out.frame_offset or 0, by_residue=bool(out.by_residue), sigma=1.0 if out.sigma is None else out.sigma)


INHERITED = ("cutoff", "sigma", "padding", "by_residue", "frame_offset", "grid")
