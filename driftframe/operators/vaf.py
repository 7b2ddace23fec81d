"""Velocity autocorrelation functions and their running integrals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.functions.constants import DIFFUSION_CM2_S
from driftframe.model import Trajectory
from driftframe.operators.lag import lag_pairs
from driftframe.operators.msd import _partners, blocked, series, spread
from driftframe.operators.stats import mean_std_sem
from driftframe.params import InputError, Params

INTEGRATIONS = ("trapezoid", "trapezoid-simple", "simpson")
_SERIES = ("species", "traj_id", "block")


def running_integral(value: str, order: str, last: int, step: float, mode: str, by: tuple[str, ...]) -> Column:
    """Running integral of ``value`` at ``order`` = 0..last, spaced ``step``.

    ``trapezoid`` gives every point but the very first and last its full weight, so it is the usual rule
    only there; ``trapezoid-simple`` is the usual rule at each point; ``simpson`` weighs even points 4/3
    and odd ones 2/3, the ends 1/3.
    """
    if mode not in INTEGRATIONS:
        raise InputError(f"unknown integration {mode!r}; there are {INTEGRATIONS}")
    k, f, h = F.col(order), F.col(value), F.lit(float(step))
    up_to = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if mode == "trapezoid-simple":
        # the sum of (f_k + f_{k-1})/2 is the running sum less half of the first and the current value
        return (F.sum(f).over(up_to) - (F.first(f).over(up_to) + f) / 2) * h
    if mode == "trapezoid":
        weight = F.when((k == 0) | (k == last), 0.5).otherwise(1.0)
    else:
        weight = F.when((k == 0) | (k == last), 1 / 3).when(k % 2 == 0, 4 / 3).otherwise(2 / 3)
    return F.sum(f * weight).over(up_to) * h


def vaf_blocks(traj: Trajectory, params: Params, array: str = "velocities", integration: str = "trapezoid", atom_indices: Iterable[int] | None = None) -> DataFrame:
    """(species, traj_id, block, t_idx, t_fs, vaf, vaf_integral): a true mean, from lag 0.

    ``vaf_integral`` is in cm^2/s; with do_com only it is multiplied by the species' number of atoms.
    """
    if integration not in INTEGRATIONS:
        raise InputError(f"unknown integration {integration!r}; there are {INTEGRATIONS}")
    species = params.species or traj.species()
    rows, sizes = series(traj, array, species, atom_indices, params.do_com)
    s = params.stepsize_t
    pairs = lag_pairs(blocked(traj, rows, params, params.stepsize_tau), _partners(rows), s, 0, params.nr_of_t, ("traj_id", "species", "atom_idx"))
    sums = pairs.groupBy("traj_id", "species", "block", "k").agg(F.avg(G.dot(G.vector("x", "y", "z"), G.vector("qx", "qy", "qz"))).alias("vaf"))
    out = spread(sums, sizes, params.do_com)
    total = running_integral("vaf", "k", params.nr_of_t - 1, traj.timestep_fs * s, integration, _SERIES)
    return out.withColumn("__i", total).select(
        *_SERIES, F.col("k").alias("t_idx"), (F.col("k") * F.lit(traj.timestep_fs * s)).alias("t_fs"), "vaf",
        (F.col("__i") * F.lit(DIFFUSION_CM2_S / 3) * F.col("scale")).alias("vaf_integral"),
    )


def vaf_diffusion_blocks(blocks: DataFrame, params: Params) -> DataFrame:
    """(species, traj_id, block, diffusion_cm2_s): the mean integral over the only fit window."""
    if len(params.fits) != 1:
        raise InputError("a velocity autocorrelation takes one fit window")
    (a, b) = params.slices()[0]
    return blocks.where((F.col("t_idx") >= a) & (F.col("t_idx") < b)).groupBy(*_SERIES).agg(F.avg("vaf_integral").alias("diffusion_cm2_s"))


def vaf_diffusion(blocks: DataFrame, params: Params) -> DataFrame:
    """(species, diffusion_mean, _std, _sem): over all trajectories and blocks; one block has deviation 0 and sem NaN."""
    per_block = vaf_diffusion_blocks(blocks, params)
    n = F.count("diffusion_cm2_s")
    sem = F.when(n > 1, F.stddev_pop("diffusion_cm2_s") / F.sqrt((F.greatest(n, F.lit(2)) - 1).cast("double"))).otherwise(F.lit(float("nan")))
    mean, _, _ = mean_std_sem("diffusion_cm2_s", "diffusion_")
    return per_block.groupBy("species").agg(mean, F.stddev_pop("diffusion_cm2_s").alias("diffusion_std"), sem.alias("diffusion_sem"))
