"""The test tables seen as trajectories, a thermo table and a grid."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.model import Trajectory, combined, inline

TYPES = ("H",) * 5 + ("O",) * 3 + ("Li",) * 2
MASS = {"H": 1.008, "O": 15.999, "Li": 6.94}
UNIT = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
TIMESTEP = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms10(spark: SparkSession) -> DataFrame:
    return inline(spark, [(0, i, t, MASS[t]) for i, t in enumerate(TYPES)], "traj_id int, atom_idx int, type string, mass double")


def traj_ev(spark: SparkSession, sf_dir: str) -> Trajectory:
    """Ten atoms, a step for every ten events; positions only."""
    e = table(spark, sf_dir, "events")
    frames = e.select(
        F.lit(0).alias("traj_id"), F.floor(F.col("event_id") / 10).cast("int").alias("step"), (F.col("event_id") % 10).cast("int").alias("atom_idx"),
        F.col("value").cast("double").alias("x"), F.col("user_id").cast("double").alias("y"), (F.col("event_id") % 97).cast("double").alias("z"),
    )
    return Trajectory(frames, atoms10(spark), TIMESTEP, ((50.0, 0.0, 0.0), (0.0, 60.0, 0.0), (0.0, 0.0, 70.0)))


def traj_emb(spark: SparkSession, sf_dir: str, variable_cell: bool = False) -> Trajectory:
    """Ten atoms with positions, velocities and forces in a unit cube, or in cells that breathe with the step."""
    e = table(spark, sf_dir, "embeddings")
    names = ("x", "y", "z", "vx", "vy", "vz", "fx", "fy", "fz")
    frames = e.select(F.lit(0).alias("traj_id"), F.floor(F.col("vec_id") / 10).cast("int").alias("step"), (F.col("vec_id") % 10).cast("int").alias("atom_idx"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    if not variable_cell:
        return Trajectory(frames, atoms10(spark), TIMESTEP, UNIT)
    z = F.lit(0.0)
    rows = [1 + (F.col("step") % 5) * 0.01, z, z, z, 1 + (F.col("step") % 3) * 0.01, z, z, z, F.lit(1.0)]
    cells = frames.select("traj_id", "step").distinct().select("traj_id", "step", *[c.cast("double").alias(n) for c, n in zip(rows, ("ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"))])
    return Trajectory(frames, atoms10(spark), TIMESTEP, None, cells)


def halves(traj: Trajectory) -> Trajectory:
    """The first and second half of a trajectory as two."""
    h = traj.nsteps[0] // 2
    first = replace(traj, frames=traj.frames.where(F.col("step") < h))
    second = replace(traj, frames=traj.frames.where((F.col("step") >= h) & (F.col("step") < 2 * h)).withColumn("step", F.col("step") - h))
    return combined([first, second])


def grid10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events on a grid of 10 x 10 x 10: each point sums every thousandth."""
    i = F.col("event_id")
    at = [(i % 10).cast("int").alias("ix"), (F.floor(i / 10) % 10).cast("int").alias("iy"), (F.floor(i / 100) % 10).cast("int").alias("iz")]
    return table(spark, sf_dir, "events").groupBy(*at).agg(F.round(F.sum(F.col("value").cast("double")), 4).alias("value"))


# -- the same views for the oracle -----------------------------------------------------------------

EV = """traj_ev as (select cast(0 as int) as traj_id, cast(floor(event_id/10) as int) as step, cast(event_id % 10 as int) as atom_idx,
  cast(value as double) as x, cast(user_id as double) as y, cast(event_id % 97 as double) as z from events)"""
EMB = """traj_emb as (select cast(0 as int) as traj_id, cast(floor(vec_id/10) as int) as step, cast(vec_id % 10 as int) as atom_idx,
  cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z,
  cast(embedding[4] as double) as vx, cast(embedding[5] as double) as vy, cast(embedding[6] as double) as vz,
  cast(embedding[7] as double) as fx, cast(embedding[8] as double) as fy, cast(embedding[9] as double) as fz from embeddings)"""
ATOMS = """atoms10 as (select cast(a as int) as atom_idx, case when a < 5 then 'H' when a < 8 then 'O' else 'Li' end as type,
  cast(case when a < 5 then 1.008 when a < 8 then 15.999 else 6.94 end as double) as mass from (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) t(a)),
  sizes as (select type, cast(count(*) as double) as n from atoms10 group by type)"""
CELLS = """cells_emb as (select distinct traj_id, step, cast(1 + (step % 5)*0.01 as double) as ax, cast(1 + (step % 3)*0.01 as double) as by_, cast(1 as double) as cz from traj_emb)"""
GRID = """grid10 as (select cast(event_id % 10 as int) as ix, cast(floor(event_id/10) % 10 as int) as iy, cast(floor(event_id/100) % 10 as int) as iz,
  round(sum(cast(value as double)), 4) as value from events group by all)"""
HALVES = """h as (select cast(floor((max(step)+1)/2) as int) as h from traj_ev),
  traj_2 as (select cast(floor(step/h) as int) as traj_id, cast(step % h as int) as step, atom_idx, x, y, z from traj_ev, h where step < 2*h)"""
