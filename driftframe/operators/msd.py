"""Mean-square displacements over lagged pairs of positions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.model import Trajectory, inline
from driftframe.operators.lag import lag_pairs
from driftframe.operators.recenter import centre
from driftframe.params import InputError, Params

_AXIS_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def selected(traj: Trajectory, species: Sequence[str], atom_indices: Iterable[int] | None = None) -> DataFrame:
    """(traj_id, atom_idx, species); ``atom_indices`` are counted from 1, so 0 never matches."""
    atoms = traj.select_atoms(species, None if atom_indices is None else [i - 1 for i in atom_indices])
    return atoms.select("traj_id", "atom_idx", F.col("type").alias("species"))


def series(traj: Trajectory, array: str, species: Sequence[str], atom_indices: Iterable[int] | None, do_com: bool) -> tuple[DataFrame, DataFrame]:
    """The vectors to correlate, (traj_id, species, atom_idx, step, x, y, z), and (traj_id, species, n, scale).

    With ``do_com`` there is one pseudo-atom, the centre of mass of all atoms, that stands for each
    species; ``scale`` is then the number of the species' atoms, else 1.
    """
    columns = traj.columns_of(array)
    names = [F.col(c).alias(a) for c, a in zip(columns, G.AXES)]
    if len(columns) != 3:
        raise ValueError(f"{array!r} is no vector")
    chosen = selected(traj, species, None if do_com else atom_indices)
    sizes = chosen.groupBy("traj_id", "species").agg(F.count("*").alias("n"))
    if not do_com:
        rows = traj.of_atoms(chosen, "species").select("traj_id", "species", "atom_idx", "step", *names)
        return rows, sizes.withColumn("scale", F.lit(1.0))
    if atom_indices is not None and 1 not in set(atom_indices):
        raise InputError("with do_com only the pseudo-atom 1 is there")
    rows = centre(traj, array).select("traj_id", F.lit("").alias("species"), F.lit(0).alias("atom_idx"), "step", *names)
    return rows, sizes.select("traj_id", "species", F.lit(1).cast("long").alias("n"), F.col("n").cast("double").alias("scale"))


def blocked(traj: Trajectory, rows: DataFrame, params: Params, q: int) -> DataFrame:
    """Origins: the rows in a block, every ``q``-th step from its start, with ``block`` and ``__size``.

    Block lengths differ only by trajectory; that table has a row for each trajectory handed in.
    """
    sizes = [(t, *params.blocks(n)) for t, n in sorted(traj.nsteps.items())]
    table = inline(traj.spark, sizes, "traj_id int, __size long, __blocks long")
    rows = rows.join(F.broadcast(table), "traj_id").where(F.col("step") < F.col("__size") * F.col("__blocks"))
    return rows.where(F.col("step") % F.col("__size") % q == 0).withColumn("block", F.floor(F.col("step") / F.col("__size")).cast("int")).drop("__blocks")


def spread(out: DataFrame, sizes: DataFrame, do_com: bool) -> DataFrame:
    """Joins the species' sizes; with ``do_com`` each species gets the pseudo-atom's rows."""
    sizes = F.broadcast(sizes)  # a row per trajectory and type: at most trajectories x elements
    return out.drop("species").join(sizes, "traj_id") if do_com else out.join(sizes, ["traj_id", "species"])


def _products(decomposed: bool) -> list[Column]:
    d = [F.col(f"q{a}") - F.col(a) for a in G.AXES]
    if decomposed:  # the tensor is symmetric: six sums, mirrored afterwards
        return [F.sum(d[i] * d[j]).alias(f"s{i}{j}") for i, j in _AXIS_PAIRS]
    return [F.sum(G.norm2(d)).alias("s")]


def _partners(rows: DataFrame) -> DataFrame:
    return rows.select("traj_id", "species", "atom_idx", "step", *[F.col(a).alias(f"q{a}") for a in G.AXES])


def mirrored(df: DataFrame, value: str) -> DataFrame:
    """Rows (i, j) of a symmetric tensor whose six sums are in columns s00..s22."""
    entries = [F.struct(F.lit(G.AXES[i]).alias("i"), F.lit(G.AXES[j]).alias("j"), F.col(f"s{min(i, j)}{max(i, j)}").alias(value)) for i in range(3) for j in range(3)]
    rest = [c for c in df.columns if c not in {f"s{i}{j}" for i, j in _AXIS_PAIRS}]
    return df.select(*rest, F.explode(F.array(*entries)).alias("e")).select(*rest, "e.*")


def msd_blocks(traj: Trajectory, params: Params, decomposed: bool = False, atom_indices: Iterable[int] | None = None) -> DataFrame:
    """(species, traj_id, block, t_idx, t_fs, lag_dt, [i, j,] msd).

    The lag of ``t_idx`` k is stepsize_t * (k + 1) steps (``lag_dt``) while its label t_fs is
    k * stepsize_t * timestep. Sums over atoms and origins are divided by
    atoms * block length / stepsize_tau, whether or not that divides. Species without atoms have no rows.
    """
    species = params.species or traj.species()
    rows, sizes = series(traj, "positions", species, atom_indices, params.do_com)
    s, q = params.stepsize_t, params.stepsize_tau
    pairs = lag_pairs(blocked(traj, rows, params, q), _partners(rows), s, 1, params.nr_of_t, ("traj_id", "species", "atom_idx"))
    sums = pairs.groupBy("traj_id", "species", "block", "k").agg(F.first("__size").alias("__size"), *_products(decomposed))
    out = spread(mirrored(sums, "s") if decomposed else sums, sizes, params.do_com)
    msd = F.col("s") * F.lit(float(q)) / (F.col("__size") * F.col("n")) * F.col("scale")
    return out.select(
        "species", "traj_id", "block", (F.col("k") - 1).alias("t_idx"), ((F.col("k") - 1) * F.lit(traj.timestep_fs * s)).alias("t_fs"),
        (F.col("k") * s).alias("lag_dt"), *(("i", "j") if decomposed else ()), msd.alias("msd"),
    )


def msd_long(traj: Trajectory, params: Params, atom_indices: Iterable[int] | None = None) -> DataFrame:
    """(species, traj_id, t_idx, t_fs, msd): isotropic, over all origins that a lag allows; stepsize_tau doesn't count.

    A lag without any origin has msd 0.
    """
    species = params.species or traj.species()
    rows, sizes = series(traj, "positions", species, atom_indices, params.do_com)
    s = params.stepsize_t
    counts = {t: params.long_t(n) for t, n in traj.nsteps.items()}
    pairs = lag_pairs(rows, _partners(rows), s, 1, max(counts.values(), default=0), ("traj_id", "species", "atom_idx"))
    sums = pairs.groupBy("traj_id", "species", "k").agg(F.avg(G.norm2([F.col(f"q{a}") - F.col(a) for a in G.AXES])).alias("s"))
    found = spread(sums, sizes, params.do_com).select("traj_id", "species", "k", (F.col("s") * F.col("scale")).alias("msd"))
    table = inline(traj.spark, [(t, n) for t, n in sorted(counts.items()) if n > 0], "traj_id int, __n int")
    lags = sizes.join(F.broadcast(table), "traj_id").select("traj_id", "species", F.explode(F.sequence(F.lit(1), "__n")).alias("k"))
    out = lags.join(found, ["traj_id", "species", "k"], "left")
    return out.select("species", "traj_id", (F.col("k") - 1).alias("t_idx"), ((F.col("k") - 1) * F.lit(traj.timestep_fs * s)).alias("t_fs"), F.coalesce("msd", F.lit(0.0)).alias("msd"))
