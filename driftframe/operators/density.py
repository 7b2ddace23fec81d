"""Gaussian-smeared density of a species on a grid."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.model import Trajectory
from driftframe.operators.grid import INDEX
from driftframe.params import InputError


@dataclass(frozen=True)
class GridSpec:
    """Points along each axis, half width of the stencil along each, smearing and cell."""

    shape: tuple[int, int, int]
    reach: tuple[int, int, int]
    sigma: float
    cell: tuple[tuple[float, ...], ...]

    @property
    def volume(self) -> float:
        return abs(G.det(self.cell))


def grid_spec(cell: Sequence[Sequence[float]], sigma: float = 0.3, n_sigma: float = 3.0, spacing: float = 0.1) -> GridSpec:
    """``spacing`` is in Angstrom; the stencil reaches int(|g| sigma n_sigma / spacing^2) + 1 points, g the axis' reciprocal vector."""
    rows = tuple(tuple(map(float, r)) for r in cell)
    shape = tuple(int(G.norm(r) / spacing) + 1 for r in rows)
    spec = GridSpec(shape, (0, 0, 0), sigma, rows)
    reciprocal = [G.norm(G.cross(rows[(i + 1) % 3], rows[(i + 2) % 3])) / spec.volume for i in range(3)]
    return GridSpec(shape, tuple(int(g * sigma * n_sigma / spacing**2) + 1 for g in reciprocal), sigma, rows)


def gaussian_density(traj: Trajectory, element: str | None = None, spec: GridSpec | None = None, istart: int = 1, istop: int | None = None, stepsize: int = 1, atom_indices: Iterable[int] | None = None, fixed: bool = False, **options: float) -> DataFrame:
    """(ix, iy, iz, value) of the grid points reached; value times cell volume / points sums to the number of atoms.

    Frames are counted from 1 and ``istop`` is the last. Grid index i stands for the fraction (i + 1)/n.
    ``atom_indices`` are counted from 1. Every atom adds exp(-d^2/2 sigma^2) to the points of a box around
    it; the rows of the stencil are summed in their task before they are shuffled, so what is shuffled is
    a grid per task at most. Other than right-angled cells need ``fixed``.
    """
    if spec is None:
        if traj.cell is None:
            raise InputError("a density needs a constant cell or a GridSpec")
        spec = grid_spec(traj.cell, **options)
    if not fixed and not G.right_angled(spec.cell):
        raise InputError("cells without right angles need fixed=True")
    chosen = traj.select_atoms(None if element is None else [element], None if atom_indices is None else [i - 1 for i in atom_indices])
    atoms = chosen.select("atom_idx").distinct().count()
    if not atoms:
        raise InputError(f"no atom of {element!r}")
    stop = max(traj.nsteps.values()) if istop is None else istop
    at = F.col("step") + 1
    rows = traj.of_atoms(chosen).where((at >= istart) & (at <= stop) & ((at - istart) % stepsize == 0))
    cell = G.constant_cell(spec.cell)
    fractions = [G.truncated(f) for f in G.fractional(G.vector("x", "y", "z"), cell)]
    rows = rows.select(*[F.when(f < 0, f + 1).otherwise(f).alias(f"f{i}") for i, f in enumerate(fractions)])
    for i, (n, b) in enumerate(zip(spec.shape, spec.reach)):
        centre = (F.col(f"f{i}") * n).cast("int") + 1
        rows = rows.withColumn(f"s{i}", F.explode(F.sequence(centre - b, centre + b)))
    off = G.times([F.col(f"s{i}") / F.lit(float(n)) - F.col(f"f{i}") for i, n in enumerate(spec.shape)], cell)
    weight = F.exp(-G.norm2(off) / F.lit(2 * spec.sigma**2))
    cells = rows.select(*[F.pmod(F.col(f"s{i}") - 1, F.lit(n)).cast("int").alias(name) for i, (n, name) in enumerate(zip(spec.shape, INDEX))], weight.alias("w"))
    sums = cells.groupBy(*INDEX).agg(F.sum("w").alias("w"))
    whole = sums.agg(F.sum("w").alias("__all"))  # one row
    points = spec.shape[0] * spec.shape[1] * spec.shape[2]
    return sums.join(F.broadcast(whole)).select(*INDEX, (F.col("w") * F.lit(atoms * points / spec.volume) / F.col("__all")).alias("value"))
