"""Running parameters of the time-correlation operators: units to steps, exclusive groups, defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any


class InputError(ValueError):
    """Parameters that contradict each other, are missing or unknown."""


UNITS = ("fs", "ps", "dt")
_TIMES = ("t_start", "t_end", "t_start_fit", "t_end_fit", "t_long_end", "block_length")
_OTHERS = ("stepsize_t", "stepsize_tau", "nr_of_blocks", "species_of_interest", "do_com", "do_long", "t_long_factor")


@dataclass(frozen=True)
class Params:
    """All in steps. Fit windows are pairs [start, end)."""

    timestep_fs: float
    stepsize_t: int
    stepsize_tau: int
    t_end: int
    fits: tuple[tuple[int, int], ...]
    nr_of_blocks: int | None
    block_length: int | None
    do_com: bool
    do_long: bool
    t_long_end: int | None
    t_long_factor: float | None
    species: tuple[str, ...] | None

    @property
    def nr_of_t(self) -> int:
        return self.t_end // self.stepsize_t

    def blocks(self, nstep: int) -> tuple[int, int]:
        """(length, number) of the blocks of a trajectory of ``nstep`` steps."""
        room = nstep - self.t_end
        if self.block_length is not None:
            length, number = self.block_length, (room // self.block_length if self.block_length > 0 else 0)
        else:
            number = 1 if self.nr_of_blocks is None else self.nr_of_blocks
            length = room // number if number > 0 else 0
        if length <= 0 or number <= 0:
            raise InputError(f"no block fits: {nstep} steps, t_end {self.t_end}, block length {self.block_length}, blocks {self.nr_of_blocks}")
        return length, number

    def long_t(self, nstep: int) -> int:
        """Number of lags of the statistics over all origins."""
        if self.t_long_end is not None:
            n = self.t_long_end // self.stepsize_t
        elif self.t_long_factor is not None:
            n = int(self.t_long_factor * nstep / self.stepsize_t)
        else:
            n = (nstep - 1) // self.stepsize_t
        if n > nstep:
            raise InputError(f"{n} long lags for {nstep} steps")
        return n

    def slices(self) -> list[tuple[int, int]]:
        """Fit windows in lag numbers."""
        return [(a // self.stepsize_t, b // self.stepsize_t) for a, b in self.fits]


def in_steps(value: Any, unit: str, timestep_fs: float) -> Any:
    """Scalars are truncated, sequences rounded half to even."""
    factor = {"fs": 1 / timestep_fs, "ps": 1000 / timestep_fs, "dt": 1}[unit]
    if isinstance(value, Sequence):
        return [round(float(v) * factor) for v in value]
    return int(float(value) * factor) if unit != "dt" else int(value)


def resolve(options: Mapping[str, Any], timestep_fs: float) -> Params:
    """Params from keyword options such as ``t_end_fit_ps`` or ``block_length_dt``; unknown ones are refused."""
    left = dict(options)

    def time(name: str) -> Any:
        given = [u for u in UNITS if left.get(f"{name}_{u}") is not None]
        if len(given) > 1:
            raise InputError(f"{name} is given in more than one unit: {given}")
        value = in_steps(left[f"{name}_{given[0]}"], given[0], timestep_fs) if given else None
        for u in UNITS:
            left.pop(f"{name}_{u}", None)
        return value

    t = {name: time(name) for name in _TIMES}
    got = {name: left.pop(name, None) for name in _OTHERS}
    if left:
        raise InputError(f"unknown parameters: {sorted(left)}")
    if t["block_length"] is not None and got["nr_of_blocks"] is not None:
        raise InputError("give block_length or nr_of_blocks, not both")
    if t["t_long_end"] is not None and got["t_long_factor"] is not None:
        raise InputError("give t_long_end or t_long_factor, not both")
    if t["t_start"]:
        raise NotImplementedError("t_start > 0")
    if t["t_end_fit"] is None:
        raise InputError("t_end_fit is mandatory")
    start, end = t["t_start_fit"] if t["t_start_fit"] is not None else 0, t["t_end_fit"]
    if isinstance(start, list) != isinstance(end, list) and not (start == 0):
        raise InputError("t_start_fit and t_end_fit are both scalars or both lists")
    ends = end if isinstance(end, list) else [end]
    starts = start if isinstance(start, list) else [start] * len(ends)
    if len(starts) != len(ends):
        raise InputError("t_start_fit and t_end_fit differ in length")
    if any(a >= b or a < 0 for a, b in zip(starts, ends)):
        raise InputError(f"a fit window ends before it starts: {list(zip(starts, ends))}")
    t_end = max(ends) if t["t_end"] is None else t["t_end"]
    if t_end < max(ends):
        raise InputError(f"t_end {t_end} is before the end of a fit, {max(ends)}")
    steps = {k: int(got[k] or 1) for k in ("stepsize_t", "stepsize_tau")}
    if min(steps.values()) < 1:
        raise InputError("step sizes start at 1")
    if got["nr_of_blocks"] is not None and int(got["nr_of_blocks"]) < 1:
        raise InputError("nr_of_blocks starts at 1")
    species = got["species_of_interest"]
    species = (species,) if isinstance(species, str) else None if species is None else tuple(species)
    return Params(
        timestep_fs, steps["stepsize_t"], steps["stepsize_tau"], t_end, tuple(zip(starts, ends)), None if got["nr_of_blocks"] is None else int(got["nr_of_blocks"]),
        t["block_length"], bool(got["do_com"]), bool(got["do_long"]), t["t_long_end"], got["t_long_factor"], species,
    )
