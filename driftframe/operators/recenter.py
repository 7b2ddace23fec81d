"""Centre of mass, recentering and velocities from positions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.model import ATOM_ARRAYS, Trajectory


def _weights(traj: Trajectory, sublattice: Iterable[str | int] | None, mode: str | None) -> DataFrame:
    """(traj_id, atom_idx, w) of the atoms that count; w isn't normalised."""
    if mode not in (None, "mass", "geometric"):
        raise ValueError(f"unknown mode {mode!r}")
    atoms = traj.atoms
    if sublattice is not None:
        if isinstance(sublattice, str) or not isinstance(sublattice, (list, tuple, set, frozenset)):
            raise TypeError("sublattice is a list, tuple or set")
        if bad := [s for s in sublattice if isinstance(s, bool) or not isinstance(s, (str, int))]:
            raise TypeError(f"{bad[0]!r} is no sublattice")
        symbols, indices = [s for s in sublattice if isinstance(s, str)], [i for i in sublattice if isinstance(i, int)]
        atoms = atoms.where(F.col("type").isin(symbols) | F.col("atom_idx").isin(indices))
        if atoms.limit(1).count() == 0:
            raise IndexError(f"no atom in {list(sublattice)!r}")
    return atoms.select("traj_id", "atom_idx", (F.lit(1.0) if mode == "geometric" else F.col("mass")).alias("w"))


def centre(traj: Trajectory, array: str = "positions", sublattice: Iterable[str | int] | None = None, mode: str | None = None) -> DataFrame:
    """(traj_id, step, the array's columns): its weighted mean over atoms, a partial sum before the shuffle."""
    columns = traj.columns_of(array)
    rows = traj.of_atoms(_weights(traj, sublattice, mode), "w")
    return rows.groupBy("traj_id", "step").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in columns])


def recenter(traj: Trajectory, sublattice: Iterable[str | int] | None = None, mode: str | None = None) -> Trajectory:
    """Positions and velocities of all atoms less the weighted mean of the chosen ones, step by step.

    Weights are masses, or 1 with ``mode="geometric"``. The means, a row per step, are aggregated first
    and joined back, so no step's atoms need to meet in one task.
    """
    names = [n for n in ("positions", "velocities") if n in traj]
    columns = [c for n in names for c in ATOM_ARRAYS[n]]
    rows = traj.of_atoms(_weights(traj, sublattice, mode), "w")
    means = rows.groupBy("traj_id", "step").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"__{c}") for c in columns])
    shifted = traj.frames.join(means, ["traj_id", "step"]).withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns})
    return replace(traj, frames=shifted.select(*traj.frames.columns))


def velocities_from_positions(traj: Trajectory, overwrite: bool = False) -> Trajectory:
    """Central differences; one-sided ones at the first and last step. A single step gives null."""
    if "velocities" in traj and not overwrite:
        raise ValueError("there are velocities already")
    w = Window.partitionBy("traj_id", "atom_idx").orderBy("step")
    dt = F.lit(float(traj.timestep_fs))
    new = {}
    for c, v in zip(ATOM_ARRAYS["positions"], ATOM_ARRAYS["velocities"]):
        before, after, here = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        new[v] = F.when(before.isNull(), (after - here) / dt).when(after.isNull(), (here - before) / dt).otherwise((after - before) / (2 * dt))
    return replace(traj, frames=traj.frames.withColumns(new))
