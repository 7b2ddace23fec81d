"""Scalar fields on grids, as tables (ix, iy, iz, value) with indices from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


INDEX = ("ix", "iy", "iz")


def full_grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Every index of a grid, from one distributed range: no product of tables."""
    nx, ny, nz = shape
    i = F.col("id")
    return spark.range(nx * ny * nz).select((i % nx).cast("int").alias("ix"), (F.floor(i / nx) % ny).cast("int").alias("iy"), F.floor(i / (nx * ny)).cast("int").alias("iz"))


def dense(grid: DataFrame, shape: Sequence[int]) -> DataFrame:
    """All grid points; those that ``grid`` lacks are 0."""
    return full_grid(grid.sparkSession, shape).join(grid, list(INDEX), "left").select(*INDEX, F.coalesce("value", F.lit(0.0)).alias("value"))


def padded(grid: DataFrame, shape: Sequence[int]) -> DataFrame:
    """n + 1 points along each axis: index n repeats index 0. Each point is copied at most eight times, without a join."""
    out = grid
    for name, n in zip(INDEX, shape):
        out = out.withColumn(name, F.explode(F.when(F.col(name) == 0, F.array(F.lit(0), F.lit(n))).otherwise(F.array(F.col(name)))))
    return out


def tiled(grid: DataFrame, shape: Sequence[int], repeat: Sequence[int]) -> DataFrame:
    """The grid repeated along its axes."""
    out = grid
    for name, n, times in zip(INDEX, shape, repeat):
        out = out.withColumn(name, F.explode(F.array(*[(F.col(name) + k * n).cast("int") for k in range(times)])))
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b, point by point; a point that one of them lacks is 0 there."""
    one, other = a.select(*INDEX, F.col("value").alias("a")), b.select(*INDEX, F.col("value").alias("b"))
    return one.join(other, list(INDEX), "full").select(*INDEX, (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("value"))


def summary(grid: DataFrame) -> DataFrame:
    """One row: least, most, total, mean, std (population)."""
    v = F.col("value")
    return grid.agg(F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def log_density(grid: DataFrame, floor: float = -120.0) -> DataFrame:
    """log10 of the values; ``floor`` where there is none."""
    v = F.col("value")
    return grid.withColumn("value", F.when(v > 0, F.log10(F.greatest(v, F.lit(5e-324)))).otherwise(F.lit(floor)))
