"""Power spectra: periodograms of contiguous blocks, averaged over atoms and axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.model import Trajectory, inline
from driftframe.operators.msd import selected
from driftframe.operators.stats import mean_std_sem
from driftframe.params import InputError

_PERIODOGRAM = "traj_id int, species string, block int, k int, p double"
#: Rows of an atom's consecutive blocks that are transformed together, at least one block.
GROUP_ROWS = 1 << 16


def block_sizes(nsteps: dict[int, int], nr_of_blocks: int | None, block_length: int | None) -> dict[int, tuple[int, int]]:
    """(length, number) for each trajectory; a remainder at the end isn't used."""
    if nr_of_blocks is not None and block_length is not None:
        raise InputError("give block_length or nr_of_blocks, not both")
    out = {}
    for t, n in nsteps.items():
        length = block_length if block_length is not None else n // (1 if nr_of_blocks is None else nr_of_blocks) if nr_of_blocks != 0 else 0
        number = n // length if block_length is not None and length > 0 else (1 if nr_of_blocks is None else nr_of_blocks)
        if length < 1 or number < 1:
            raise InputError(f"no block fits {n} steps")
        out[t] = (length, number)
    return out


def power_spectrum(traj: Trajectory, array: str = "velocities", species: list[str] | None = None, nr_of_blocks: int | None = None, block_length: int | None = None, smothening: int = 1, mix_blocks: bool = False) -> DataFrame:
    """(species, traj_id, block, k, freq_thz, psd): one-sided densities of each block less its mean.

    A group is one atom's consecutive blocks, GROUP_ROWS rows or one block: that is what a task holds at
    once. ``smothening`` m averages m
    frequencies, zero beyond the ends; ``mix_blocks`` also sums over as many neighbouring blocks as
    there are, not divided. Atoms whose block lacks a step raise.
    """
    columns = traj.columns_of(array)
    if smothening < 1:
        raise InputError("smothening starts at 1")
    if len(columns) != 3:
        raise ValueError(f"{array!r} is no vector")
    sizes = block_sizes(traj.nsteps, nr_of_blocks, block_length)
    table = F.broadcast(inline(traj.spark, [(t, *s) for t, s in sorted(sizes.items())], "traj_id int, __size int, __blocks int"))  # a row per trajectory
    chosen = selected(traj, species or traj.species())
    rows = traj.of_atoms(chosen, "species").join(table, "traj_id").where(F.col("step") < F.col("__size") * F.col("__blocks"))
    rows = rows.select("traj_id", "species", "atom_idx", F.floor(F.col("step") / F.col("__size")).cast("int").alias("block"), "step", F.col("__size").alias("size"), *[F.col(c).alias(a) for c, a in zip(columns, G.AXES)])
    fs = 1000.0 / traj.timestep_fs

    def periodogram(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("step")
        n = int(pdf["size"].iloc[0])
        blocks, counts = np.unique(pdf["block"].to_numpy(), return_counts=True)
        if (counts != n).any():
            raise ValueError(f"a block has {counts[counts != n][0]} of {n} steps")
        v = pdf[list(G.AXES)].to_numpy().reshape(len(blocks), n, 3)
        p = (np.abs(np.fft.rfft(v - v.mean(axis=1, keepdims=True), axis=1)) ** 2).sum(axis=2) / (fs * n)
        p[:, 1 : (n + 1) // 2] *= 2
        return pd.DataFrame({"traj_id": pdf["traj_id"].iloc[0], "species": pdf["species"].iloc[0], "block": np.repeat(blocks, p.shape[1]), "k": np.tile(np.arange(p.shape[1]), len(blocks)), "p": p.ravel() / 3})

    together = F.floor(F.col("block") / F.greatest(F.floor(F.lit(GROUP_ROWS) / F.col("size")), F.lit(1)))
    each = rows.withColumn("__group", together).groupBy("traj_id", "species", "atom_idx", "__group").applyInPandas(periodogram, _PERIODOGRAM)
    out = each.groupBy("traj_id", "species", "block", "k").agg(F.avg("p").alias("psd"))
    if smothening > 1:
        near = Window.partitionBy("traj_id", "species", "block").orderBy("k").rowsBetween(-(smothening // 2), (smothening - 1) // 2)
        out = out.withColumn("psd", F.sum("psd").over(near) / smothening)
    out = out.join(table, "traj_id")
    if mix_blocks:
        out = _mixed(out)
    return out.select("species", "traj_id", "block", "k", (F.col("k") * F.lit(fs) / F.col("__size")).alias("freq_thz"), "psd")


def _mixed(out: DataFrame) -> DataFrame:
    """Sums over a window of as many blocks as there are, centred like an even or odd kernel: blocks b - n // 2 to b + (n - 1) // 2.

    Such a window reaches the first block (b <= n // 2) or the last one, so a sum is a running total from that
    end. A row is a value for the totals from both ends, and asks one of them for its sum: three rows for each.
    """
    b, n = F.col("block"), F.col("__blocks")
    half, rest = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    value = [F.struct(at.alias("at"), F.lit(end).alias("end"), F.col("psd").alias("v"), F.lit(None).cast("int").alias("block")) for end, at in enumerate((b, -b))]
    asked = F.when(b <= half, F.struct((b + rest).alias("at"), F.lit(0).alias("end"))).otherwise(F.struct((half - b).alias("at"), F.lit(1).alias("end")))
    asks = F.struct(asked["at"].alias("at"), asked["end"].alias("end"), F.lit(None).cast("double").alias("v"), b.alias("block"))
    keys = ["traj_id", "species", "k", "__size", "__blocks"]
    rows = out.select(*keys, F.explode(F.array(*value, asks)).alias("r")).select(*keys, "r.*")
    so_far = Window.partitionBy(*keys, "end").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("psd", F.sum("v").over(so_far)).where(F.col("block").isNotNull()).select(*keys, "block", "psd")


def spectrum_stats(spectrum: DataFrame) -> DataFrame:
    """(species, k, freq_thz, mean, std, sem) over trajectories and blocks, where all have the same frequency at k.

    Trajectories whose blocks differ in length share only k = 0; ``DynamicsAnalyzer`` then leaves the statistics out.
    """
    stats = spectrum.groupBy("species", "k").agg(F.min("freq_thz").alias("freq_thz"), F.max("freq_thz").alias("__most"), *mean_std_sem("psd"))
    return stats.where("freq_thz = __most").drop("__most")
