"""The user's entry points: analyzers that hold trajectories and return bundles of result tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.functions.constants import DIFFUSION_CM2_S
from driftframe.model import Trajectory, combined
from driftframe.operators import angular_spectrum, rdf, rdf_summary
from driftframe.operators.kinetic import kinetic_energies, kinetic_means
from driftframe.operators.msd import msd_blocks, msd_long
from driftframe.operators.spectrum import block_sizes, power_spectrum, spectrum_stats
from driftframe.operators.stats import block_stats, diffusion, line_fits
from driftframe.operators.vaf import vaf_blocks, vaf_diffusion
from driftframe.params import InputError, Params, in_steps, resolve


@dataclass(frozen=True)
class TimeSeries:
    """Named result tables and attributes."""

    tables: Mapping[str, DataFrame]
    attrs: Mapping[str, Any] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def register(self, prefix: str = "") -> None:
        """Makes the tables temporary views, so that SQL can query them."""
        for name, table in self.tables.items():
            table.createOrReplaceTempView(prefix + name)

    def get_array(self, name: str) -> DataFrame:
        """One series by its array name, such as ``msd_isotropic_H_0``, ``vaf_isotropic_O_mean`` or ``periodogram_H_1``."""
        head, _, last = name.rpartition("_")
        kind, _, species = head.rpartition("_")
        stat = last in ("mean", "std", "sem")
        decomposed = kind.endswith("_decomposed")
        kind = kind.removesuffix("_isotropic").removesuffix("_decomposed")
        table, value = {"msd": ("msd", "msd"), "msd_long": ("msd_long", "msd"), "slopes_intercepts": ("fits", None), "vaf": ("vaf", "vaf"), "vaf_integral": ("vaf", "vaf_integral"), "periodogram": ("psd", "psd")}[kind]
        table = f"{value or kind}_stats" if stat else table
        if table not in self.tables:
            raise KeyError(f"no table {table!r} for {name!r}")
        rows = self.tables[table].where(F.col("species") == species)
        axes = ["i", "j"] if decomposed else []
        if stat:
            return rows.select("k" if kind == "periodogram" else "t_idx", *axes, last)
        rows = rows.where(F.col("traj_id") == int(last))
        return rows.drop("species", "traj_id") if value is None else rows.select(*[c for c in ("block", "t_idx", "k", *axes, value) if c in rows.columns])


class DynamicsAnalyzer:
    """Diffusion, correlation, temperature and spectra of compatible trajectories."""

    def __init__(self, trajectories: Sequence[Trajectory] | Trajectory | None = None, species_of_interest: Sequence[str] | str | None = None):
        self.traj, self.species = None, None
        if trajectories is not None:
            self.set_trajectories(trajectories)
        if species_of_interest is not None:
            self.set_species_of_interest(species_of_interest)

    def set_trajectories(self, trajectories: Sequence[Trajectory] | Trajectory) -> None:
        self.traj = combined([trajectories] if isinstance(trajectories, Trajectory) else list(trajectories))

    def set_species_of_interest(self, species: Sequence[str] | str) -> None:
        self.species = (species,) if isinstance(species, str) else tuple(species)

    def get_species_of_interest(self) -> tuple[str, ...]:
        return self.species or tuple(self._traj().species())

    def _traj(self) -> Trajectory:
        if self.traj is None:
            raise InputError("set_trajectories comes first")
        return self.traj

    def params(self, **options: Any) -> Params:
        if self.species is not None:
            options.setdefault("species_of_interest", self.species)
        return resolve(options, self._traj().timestep_fs)

    def get_msd(self, decomposed: bool = False, atom_indices: Iterable[int] | None = None, **options: Any) -> TimeSeries:
        """Tables msd, msd_stats, fits, diffusion and, with do_long, msd_long."""
        p, traj = self.params(**options), self._traj()
        atom_indices = None if atom_indices is None else list(atom_indices)
        axes = ["i", "j"] if decomposed else []
        blocks = msd_blocks(traj, p, decomposed, atom_indices)
        fits = line_fits(blocks, "msd", p.slices(), traj.timestep_fs * p.stepsize_t, ["species", "traj_id", "block", *axes])
        tables = {"msd": blocks, "msd_stats": block_stats(blocks, "msd", ["species", "t_idx", "t_fs", *axes]), "fits": fits, "diffusion": diffusion(fits, ["species", *axes], DIFFUSION_CM2_S / (2 if decomposed else 6))}
        if p.do_long:
            tables["msd_long"] = msd_long(traj, p, atom_indices)
        return TimeSeries(tables, self._attrs(p) | {"decomposed": decomposed, "multiple_params_fit": len(p.fits) > 1})

    def get_vaf(self, array: str = "velocities", integration: str = "trapezoid", **options: Any) -> TimeSeries:
        """Tables vaf, vaf_stats, vaf_integral_stats, diffusion."""
        p, traj = self.params(**options), self._traj()
        blocks = vaf_blocks(traj, p, array, integration)
        by = ["species", "t_idx", "t_fs"]
        return TimeSeries({"vaf": blocks, "vaf_stats": block_stats(blocks, "vaf", by), "vaf_integral_stats": block_stats(blocks, "vaf_integral", by), "diffusion": vaf_diffusion(blocks, p)}, self._attrs(p) | {"integration": integration})

    def get_kinetic_energies(self, stepsize: int = 1, decompose_system: bool = True, decompose_atoms: bool = False, decompose_species: bool = False) -> TimeSeries:
        """Tables system, species or atoms, and means."""
        tables = kinetic_energies(self._traj(), stepsize, decompose_system, decompose_species, decompose_atoms)
        return TimeSeries(tables | {"means": kinetic_means(self._traj(), stepsize)}, {"stepsize": stepsize})

    def get_power_spectrum(self, array: str = "velocities", smothening: int = 1, nr_of_blocks: int | None = None, species_of_interest: Sequence[str] | str | None = None, mix_blocks: bool = False, **options: Any) -> TimeSeries:
        """Tables psd and, unless block lengths differ, psd_stats; the block length is block_length_dt, _fs or _ps."""
        traj = self._traj()
        lengths = [in_steps(options.pop(f"block_length_{u}"), u, traj.timestep_fs) for u in ("fs", "ps", "dt") if options.get(f"block_length_{u}") is not None]
        if options or len(lengths) > 1:
            raise InputError(f"unknown or contradicting parameters: {sorted(options) or 'block_length'}")
        species = [species_of_interest] if isinstance(species_of_interest, str) else list(species_of_interest or self.get_species_of_interest())
        length = lengths[0] if lengths else None
        psd = power_spectrum(traj, array, species, nr_of_blocks, length, smothening, mix_blocks)
        same = len({s for s, _ in block_sizes(traj.nsteps, nr_of_blocks, length).values()}) == 1
        return TimeSeries({"psd": psd} | ({"psd_stats": spectrum_stats(psd)} if same else {}), {"species_of_interest": species, "smothening": smothening})

    def _attrs(self, p: Params) -> dict[str, Any]:
        traj = self._traj()
        return {
            "species_of_interest": list(p.species or self.get_species_of_interest()), "timestep_fs": p.timestep_fs, "stepsize_t": p.stepsize_t, "stepsize_tau": p.stepsize_tau,
            "t_end_dt": p.t_end, "nr_of_t": p.nr_of_t, "fits_dt": [list(f) for f in p.fits], "nr_of_trajectories": len(traj.nsteps),
            "blocks": {t: dict(zip(("block_length_dt", "nr_of_blocks"), p.blocks(n))) for t, n in traj.nsteps.items()},
        }


class RDF:
    """Radial distributions of one trajectory."""

    def __init__(self, trajectory: Trajectory):
        self.traj = trajectory

    def run(self, radius: float, species_pairs: Sequence | None = None, istart: int = 0, istop: int | None = None, stepsize: int = 1, nbins: int = 100) -> TimeSeries:
        """Tables rdf and summary."""
        args = (self.traj, radius, species_pairs, istart, istop, stepsize)
        return TimeSeries({"rdf": rdf.rdf(*args, nbins), "summary": rdf_summary(*args)}, {"radius": radius, "nbins": nbins})

    def run_fort(self, *args: Any, **options: Any) -> None:
        rdf.run_native_kernel(*args, **options)


class AngularSpectrum:
    """Angle distributions of one trajectory."""

    def __init__(self, trajectory: Trajectory):
        self.traj = trajectory

    def run(self, radius: float, species_pairs: Sequence | None = None, istart: int = 1, istop: int | None = None, stepsize: int = 1, nbins: int = 100, fixed: bool = False) -> TimeSeries:
        return TimeSeries({"angular": angular_spectrum(self.traj, radius, species_pairs, istart, istop, stepsize, nbins, fixed)}, {"radius": radius, "nbins": nbins})
