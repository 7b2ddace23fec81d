"""Frames that arrive as Parquet files while a simulation runs.

The simulated time is the event time: a watermark behind it closes a step once frames that much later
have arrived, so state holds the open steps only and rows of closed steps are dropped as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.functions.constants import KINETIC_FACTOR

FRAMES = "traj_id int, step long, atom_idx int, x double, y double, z double, vx double, vy double, vz double"


def arriving(spark: SparkSession, path: str, timestep_fs: float, schema: str = FRAMES, files_per_trigger: int = 100) -> DataFrame:
    """A stream of frames with ``sim_time``: a millisecond for each femtosecond since the start, as watermarks resolve milliseconds, and one more, as step 0 would be late at the epoch."""
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return frames.withColumn("sim_time", F.timestamp_millis((F.col("step") * F.lit(float(timestep_fs))).cast("long") + 1))


def temperatures(frames: DataFrame, atoms: DataFrame, delay_fs: int) -> DataFrame:
    """(traj_id, step, kinetic, com_x, com_y, com_z) of each step once it is ``delay_fs`` behind the latest frame.

    ``atoms`` (traj_id, atom_idx, mass) is a static table.
    """
    weighed = frames.withWatermark("sim_time", f"{delay_fs} milliseconds").join(atoms.select("traj_id", "atom_idx", "mass"), ["traj_id", "atom_idx"])
    m = F.col("mass")
    sums = weighed.groupBy("traj_id", "step", "sim_time").agg(
        (F.lit(KINETIC_FACTOR) * F.sum(m * G.norm2(G.vector("vx", "vy", "vz"))) / (3 * F.count("*"))).alias("kinetic"),
        *[(F.sum(m * F.col(a)) / F.sum(m)).alias(f"com_{a}") for a in G.AXES],
    )
    return sums.drop("sim_time")
