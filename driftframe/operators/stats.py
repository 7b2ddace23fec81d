"""Statistics over blocks, line fits and diffusion coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.model import inline

NAN = float("nan")


def mean_std_sem(column: str, name: str = "", single: float | None = NAN) -> list[Column]:
    """mean, population deviation and std/sqrt(n-1); with one value the latter two are ``single``."""
    n = F.count(column)
    std = F.when(n > 1, F.stddev_pop(column)).otherwise(F.lit(single))
    sem = F.when(n > 1, F.stddev_pop(column) / F.sqrt((F.greatest(n, F.lit(2)) - 1).cast("double"))).otherwise(F.lit(single))
    return [F.avg(column).alias(f"{name}mean"), std.alias(f"{name}std"), sem.alias(f"{name}sem")]


def block_stats(blocks: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """mean, std and sem of ``value`` over all trajectories and blocks."""
    return blocks.groupBy(*by).agg(*mean_std_sem(value))


def line_fits(blocks: DataFrame, value: str, windows: Sequence[tuple[int, int]], step_fs: float, by: Sequence[str]) -> DataFrame:
    """Least-squares lines per group and fit window [first, end) of lag numbers ``t_idx``, over t = t_idx * step_fs."""
    spark = blocks.sparkSession
    table = inline(spark, [(i, a, b) for i, (a, b) in enumerate(windows)], "fit_idx int, __a int, __b int")
    inside = blocks.join(F.broadcast(table), (F.col("t_idx") >= F.col("__a")) & (F.col("t_idx") < F.col("__b")))
    t = F.col("t_idx") * F.lit(float(step_fs))
    return inside.groupBy(*by, "fit_idx").agg(F.regr_slope(F.col(value), t).alias("slope"), F.regr_intercept(F.col(value), t).alias("intercept"))


def diffusion(fits: DataFrame, by: Sequence[str], factor: float) -> DataFrame:
    """Slope statistics over all trajectories and blocks, and the diffusion coefficients ``factor`` times them."""
    out = fits.groupBy(*by, "fit_idx").agg(*mean_std_sem("slope", "slope_"))
    return out.withColumns({f"diffusion_{s}_cm2_s": F.col(f"slope_{s}") * F.lit(factor) for s in ("mean", "std", "sem")})
