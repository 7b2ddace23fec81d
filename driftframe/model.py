"""Trajectories as long tables.

``frames`` has a row per (traj_id, step, atom_idx), steps and atoms numbered from 0, and a column per
component of each named array; ``atoms`` a row per (traj_id, atom_idx) with type and mass; ``cells`` a
row per (traj_id, step) with the lattice vectors ax..cz, or ``cell`` is one constant cell; ``steps`` a
row per (traj_id, step) with energies, stress and the like. Everything is lazy and unchangeable: each
operation returns a new Trajectory.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.functions.constants import ELEMENTS, MASSES, NUMBERS

#: Named arrays with a fixed shape: per atom, then per step.
ATOM_ARRAYS = {"positions": ("x", "y", "z"), "velocities": ("vx", "vy", "vz"), "forces": ("fx", "fy", "fz")}
STEP_ARRAYS = {"stress": ("sxx", "syy", "szz", "syz", "sxz", "sxy"), "potential_energy": ("potential_energy",)}
KEYS = ("traj_id", "step", "atom_idx")
#: Tables of at most so many rows are offered for broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000


class IncompatibleTrajectories(ValueError):
    pass


def small(df: DataFrame, rows: int) -> DataFrame:
    """Offers ``df`` for broadcast if its counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of driver-side rows; few rows become part of the plan, so that no job has to ship them."""
    if not 0 < len(rows) <= 500:
        return spark.createDataFrame(rows, schema)

    def literal(v: Any) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "null" if v is None else f"double('{v!r}')" if isinstance(v, float) else str(v)

    names = [f.strip().split(" ") for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"select {', '.join(f'cast(`{n}` as {t}) as `{n}`' for n, t in names)} from values {values} as t({', '.join(f'`{n}`' for n, _ in names)})")


@dataclass(frozen=True)
class Trajectory:
    frames: DataFrame
    atoms: DataFrame
    timestep_fs: float = 1.0
    cell: tuple[tuple[float, ...], ...] | None = None
    cells: DataFrame | None = None
    steps: DataFrame | None = None
    attrs: Mapping[str, Any] = field(default_factory=dict)

    # -- sizes --------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self.frames.sparkSession

    @cached_property
    def nsteps(self) -> dict[int, int]:
        """Steps of each trajectory; one row per trajectory reaches the driver."""
        return {r.traj_id: r.n for r in self.frames.groupBy("traj_id").agg((F.max("step") + 1).alias("n")).collect()}

    @cached_property
    def type_counts(self) -> dict[str, int]:
        """Atoms of each type over all trajectories; a row for each type reaches the driver."""
        return {r.type: r.n for r in self.atoms.groupBy("type").agg(F.count("*").alias("n")).orderBy("type").collect()}

    @property
    def nat(self) -> int:
        """Atoms of all trajectories."""
        return sum(self.type_counts.values())

    @property
    def timestep(self) -> float:
        return self.timestep_fs

    # -- arrays -------------------------------------------------------------------------------

    def array_names(self) -> list[str]:
        """Sorted names; a column of ``frames`` or ``steps`` that belongs to no named array is one of its own."""
        found = [n for n, c in ATOM_ARRAYS.items() if set(c) <= set(self.frames.columns)]
        known = {c for n in found for c in ATOM_ARRAYS[n]} | set(KEYS)
        found += [c for c in self.frames.columns if c not in known]
        if self.steps is not None:
            named = [n for n, c in STEP_ARRAYS.items() if set(c) <= set(self.steps.columns)]
            known = {c for n in named for c in STEP_ARRAYS[n]} | set(KEYS)
            found += named + [c for c in self.steps.columns if c not in known]
        return sorted(found + ["cells"] * (self.cells is not None))

    def __contains__(self, name: str) -> bool:
        return name in self.array_names()

    def columns_of(self, name: str) -> tuple[str, ...]:
        if name not in self:
            raise KeyError(f"no array {name!r}; there are {self.array_names()}")
        return G.CELL if name == "cells" else ATOM_ARRAYS.get(name) or STEP_ARRAYS.get(name) or (name,)

    def get_array(self, name: str) -> DataFrame:
        columns = self.columns_of(name)
        if name == "cells":
            return self.cells
        own = self.frames if set(columns) <= set(self.frames.columns) else self.steps
        return own.select(*[c for c in KEYS if c in own.columns], *columns)

    def set_array(self, name: str, values: DataFrame, check_existing: bool = False) -> Trajectory:
        """Adds or replaces an array given with its keys: (traj_id, step, atom_idx) for atoms, (traj_id, step) for steps.

        Every key must be there once; a key without a value raises when the table is read.
        """
        if check_existing and name in self:
            raise ValueError(f"{name!r} is there already")
        if name == "cells":
            return replace(self, cells=values.select("traj_id", "step", *G.CELL), cell=None)
        per_atom = "atom_idx" in values.columns
        if name in ATOM_ARRAYS and not per_atom or name in STEP_ARRAYS and per_atom:
            raise ValueError(f"{name!r}: keys {[c for c in KEYS if c in values.columns]} don't fit")
        keys = KEYS if per_atom else KEYS[:2]
        columns = ATOM_ARRAYS.get(name) or STEP_ARRAYS.get(name) or tuple(c for c in values.columns if c not in keys)
        missing = set(columns) - set(values.columns)
        if missing or not columns:
            raise ValueError(f"{name!r} lacks {sorted(missing)}")
        own = self.frames if per_atom else self.steps
        chosen = values.select(*keys, *columns)
        if own is None:
            return replace(self, steps=chosen)
        joined = own.drop(*columns).join(chosen.withColumn("__there", F.lit(True)), list(keys), "left")
        there = F.when(F.col("__there").isNull(), F.raise_error(F.lit(f"{name}: a key has no value")))
        joined = joined.where(there.isNull()).drop("__there")
        return replace(self, **{"frames" if per_atom else "steps": joined})

    def remove_array(self, name: str) -> Trajectory:
        columns = self.columns_of(name)
        if name == "cells":
            return replace(self, cells=None)
        if set(columns) <= set(self.frames.columns):
            return replace(self, frames=self.frames.drop(*columns))
        return replace(self, steps=self.steps.drop(*columns))

    def rescale_array(self, name: str, factor: float) -> Trajectory:
        columns = self.columns_of(name)
        scaled = {c: F.col(c) * F.lit(float(factor)) for c in columns}
        if name == "cells":
            return replace(self, cells=self.cells.withColumns(scaled))
        if set(columns) <= set(self.frames.columns):
            return replace(self, frames=self.frames.withColumns(scaled))
        return replace(self, steps=self.steps.withColumns(scaled))

    def set_attr(self, key: str, value: Any) -> Trajectory:
        json.dumps(value)  # refuses what can't be stored
        return replace(self, attrs={**self.attrs, key: value})

    def get_attr(self, key: str) -> Any:
        return self.attrs[key]

    def get_attrs(self) -> dict[str, Any]:
        return dict(self.attrs)

    def attrs_table(self) -> DataFrame:
        return self.spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(self.attrs.items())], "key string, value_json string")

    # -- selections ---------------------------------------------------------------------------

    def species(self) -> list[str]:
        """Sorted distinct types."""
        return sorted(self.type_counts)

    def select_atoms(self, species: Iterable[str] | None = None, indices: Iterable[int] | None = None) -> DataFrame:
        """Rows of ``atoms`` of these types and with these 0-based indices."""
        chosen = self.atoms
        if species is not None:
            chosen = chosen.where(F.col("type").isin([species] if isinstance(species, str) else list(species)))
        if indices is not None:
            chosen = chosen.where(F.col("atom_idx").isin(list(indices)))
        return chosen

    def indices_of_species(self, spec: str | int, start: int = 0) -> DataFrame:
        """(traj_id, atom_idx) of a type, or of the atom with that index, counted from ``start``."""
        if isinstance(spec, bool) or not isinstance(spec, (str, int)):
            raise TypeError(f"{spec!r} is no species")
        chosen = self.select_atoms([spec]) if isinstance(spec, str) else self.select_atoms(None, [spec])
        return chosen.select("traj_id", (F.col("atom_idx") + start).alias("atom_idx"))

    def of_atoms(self, atoms: DataFrame, *columns: str) -> DataFrame:
        """``frames`` rows of these atoms, with the given columns of ``atoms``."""
        return self.frames.join(small(atoms.select("traj_id", "atom_idx", *columns), self.nat), ["traj_id", "atom_idx"])

    def slice_steps(self, start: int = 0, stop: int | None = None, stepsize: int = 1) -> DataFrame:
        """Frames of steps start, start + stepsize, ... below ``stop``."""
        chosen = (F.col("step") >= start) & ((F.col("step") - start) % stepsize == 0)
        return self.frames.where(chosen if stop is None else chosen & (F.col("step") < stop))

    def snapshot(self, step: int, with_calculated: bool = True) -> DataFrame:
        """One step's atoms with types; forces, energies and stress only ``with_calculated``."""
        rows = self.frames.where(F.col("step") == step)
        if not with_calculated:
            rows = rows.drop(*ATOM_ARRAYS["forces"])
        rows = rows.join(small(self.atoms, self.nat), ["traj_id", "atom_idx"])
        return rows.join(self.steps, ["traj_id", "step"], "left") if with_calculated and self.steps is not None else rows

    # -- cells --------------------------------------------------------------------------------

    def cell_columns(self) -> list[list[Column | float]]:
        """The cell as expressions over ``with_cell(frames)``, as numbers if it is constant."""
        if self.cell is not None:
            return G.constant_cell(self.cell)
        if self.cells is None:
            raise KeyError("the trajectory has neither a cell nor cells")
        return G.cell_of()

    def with_cell(self, df: DataFrame) -> DataFrame:
        """``df`` (traj_id, step) joined with its step's cell, if cells vary."""
        return df if self.cell is not None else df.join(self.cells.select("traj_id", "step", *G.CELL), ["traj_id", "step"])

    @cached_property
    def right_angled(self) -> bool:
        """Whether all cells have axes along x, y and z; of variable cells one number reaches the driver."""
        if self.cell is not None:
            return G.right_angled(self.cell)
        off = [F.max(F.abs(F.col(G.CELL[3 * i + j]))) for i in range(3) for j in range(3) if i != j]
        return not any(self.cells.agg(*off).first())

    def volumes(self) -> DataFrame:
        """(traj_id, step, volume): signed, for every step, also with a constant cell."""
        if self.cells is not None and self.cell is None:
            return self.cells.select("traj_id", "step", G.det(G.cell_of()).alias("volume"))
        steps = self.frames.select("traj_id", "step").distinct()
        return steps.select("*", G.column(G.det(self.cell_columns())).alias("volume"))


def atoms_of_types(spark: SparkSession, types: Sequence[str], traj_id: int = 0) -> DataFrame:
    """``atoms`` of a list of symbols; unknown ones have mass 1."""
    rows = [(traj_id, i, t, MASSES.get(t, 1.0)) for i, t in enumerate(types)]
    return inline(spark, rows, "traj_id int, atom_idx int, type string, mass double")


def element_table(spark: SparkSession) -> DataFrame:
    return inline(spark, ELEMENTS, "symbol string, number int, mass double")


def from_atoms(spark: SparkSession, frames: Sequence[Mapping[str, Any]], timestep_fs: float, add_arrays: Mapping[str, Sequence] | None = None, traj_id: int = 0) -> Trajectory:
    """A Trajectory of snapshots held on the driver: mappings with symbols, positions and maybe velocities, forces, cell.

    Atoms are ordered by atomic number, ties as given. Velocities and forces stay only if their sum of
    squares over their deviation shows that they aren't all zero, cells only if they vary.
    """
    import numpy as np

    if not frames:
        raise ValueError("no snapshots")
    symbols = list(frames[0]["symbols"])
    order = sorted(range(len(symbols)), key=lambda i: NUMBERS.get(symbols[i], 0))
    if any(list(f["symbols"]) != symbols for f in frames):
        raise IncompatibleTrajectories("snapshots differ in their atoms")
    arrays = {"positions": np.array([f["positions"] for f in frames], float)[:, order]}
    for name in ("velocities", "forces"):
        if all(f.get(name) is not None for f in frames):
            values = np.array([f[name] for f in frames], float)[:, order]
            if (values**2).sum() > 1e-12 * max(values.std(), 1e-300) and values.any():
                arrays[name] = values
    extra = {k: np.asarray(v, float) for k, v in (add_arrays or {}).items()}
    n, m = arrays["positions"].shape[:2]
    data = {"traj_id": np.full(n * m, traj_id, np.int32), "step": np.repeat(np.arange(n), m), "atom_idx": np.tile(np.arange(m, dtype=np.int32), n)}
    for name, values in arrays.items():
        data |= {c: values[:, :, k].ravel() for k, c in enumerate(ATOM_ARRAYS[name])}
    steps = None
    for name, values in extra.items():
        if values.shape[:2] == (n, m) and values.ndim == 2:
            data[name] = values[:, order].ravel()
        elif values.shape == (n,):
            steps = {**(steps or {"traj_id": np.full(n, traj_id, np.int32), "step": np.arange(n)}), name: values}
        else:
            raise ValueError(f"{name}: shape {values.shape} is neither per step nor per atom")
    import pandas as pd

    cells = [f.get("cell") for f in frames]
    cell, per_step = None, None
    if all(c is not None for c in cells):
        stacked = np.array(cells, float)
        if np.ptp(stacked, axis=0).max() > 1e-12:
            per_step = spark.createDataFrame(pd.DataFrame({"traj_id": np.full(n, traj_id, np.int32), "step": np.arange(n)} | {c: stacked.reshape(n, 9)[:, k] for k, c in enumerate(G.CELL)}))
        else:
            cell = tuple(map(tuple, stacked[0].tolist()))
    return Trajectory(
        spark.createDataFrame(pd.DataFrame(data)), atoms_of_types(spark, [symbols[i] for i in order], traj_id), timestep_fs, cell, per_step,
        None if steps is None else spark.createDataFrame(pd.DataFrame(steps)),
    )


def check_compatible(trajectories: Sequence[Trajectory]) -> None:
    """Raises unless all have the same arrays, types in the same order and timestep."""
    if any(not isinstance(t, Trajectory) for t in trajectories):
        raise TypeError("not a Trajectory")
    if len({t.timestep_fs for t in trajectories}) > 1:
        raise IncompatibleTrajectories("different timesteps")
    if len({tuple(t.array_names()) for t in trajectories}) > 1:
        raise IncompatibleTrajectories("different arrays")
    first = trajectories[0].atoms.select("atom_idx", "type")
    for t in trajectories[1:]:
        other = t.atoms.select("atom_idx", F.col("type").alias("other"))
        if first.join(other, "atom_idx", "full").where("not (type <=> other)").limit(1).count():
            raise IncompatibleTrajectories("different atoms")


def combined(trajectories: Sequence[Trajectory]) -> Trajectory:
    """One Trajectory with traj_id 0, 1, ... in the order given."""
    check_compatible(trajectories)
    if len(trajectories) == 1:
        return trajectories[0]

    def numbered(get) -> DataFrame | None:
        tables = [get(t) for t in trajectories]
        if any(t is None for t in tables):
            return None
        out = None
        for k, t in enumerate(tables):
            t = t.withColumn("traj_id", F.lit(k))
            out = t if out is None else out.unionByName(t)
        return out

    cell = trajectories[0].cell if len({t.cell for t in trajectories}) == 1 else None
    return Trajectory(numbered(lambda t: t.frames), numbered(lambda t: t.atoms), trajectories[0].timestep_fs, cell, numbered(lambda t: t.cells), numbered(lambda t: t.steps), trajectories[0].attrs)
