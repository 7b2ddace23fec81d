"""Tidy tables for plots: curves with errors, per-block lines, fit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.model import inline

from driftframe.analyzer import TimeSeries
from driftframe.params import Params


def band(stats: DataFrame, x: str) -> DataFrame:
    """Curves ``x``, ``y`` with ``low`` and ``high`` one standard error away (on the curve where there is none)."""
    sem = F.when(F.isnan("sem") | F.col("sem").isNull(), F.lit(0.0)).otherwise(F.col("sem"))
    rest = [c for c in stats.columns if c in ("species", "i", "j")]
    return stats.select(*rest, F.col(x).alias("x"), F.col("mean").alias("y"), (F.col("mean") - sem).alias("low"), (F.col("mean") + sem).alias("high"))


def fit_lines(fits: DataFrame, params: Params) -> DataFrame:
    """Two end points of each block's line over its fit window, whether there is one window or a list."""
    spark = fits.sparkSession
    ends = inline(spark, [(i, x * params.timestep_fs) for i, f in enumerate(params.fits) for x in f], "fit_idx int, x double")
    return fits.join(F.broadcast(ends), "fit_idx").withColumn("y", F.col("slope") * F.col("x") + F.col("intercept")).drop("slope", "intercept")


def msd_plot(result: TimeSeries, params: Params, diagonal_only: bool = False) -> dict[str, DataFrame]:
    """Curves, single blocks and fit lines; tensors can be cut to their diagonal."""
    tables = {"curves": band(result["msd_stats"], "t_fs"), "blocks": result["msd"].withColumnsRenamed({"t_fs": "x", "msd": "y"}), "fits": fit_lines(result["fits"], params)}
    return {n: t.where("i = j") if diagonal_only and "i" in t.columns else t for n, t in tables.items()}


def vaf_plot(result: TimeSeries, params: Params) -> dict[str, DataFrame]:
    """Curves of the function and of its integral, and the fit windows' ends in fs."""
    spark = result["vaf"].sparkSession
    marks = inline(spark, [(i, x * params.timestep_fs) for i, f in enumerate(params.fits) for x in f], "fit_idx int, x double")
    return {"vaf": band(result["vaf_stats"], "t_fs"), "integral": band(result["vaf_integral_stats"], "t_fs"), "fit_marks": marks}


def spectrum_plot(result: TimeSeries) -> DataFrame:
    return band(result["psd_stats"], "freq_thz")


def rdf_plot(rdf: DataFrame) -> DataFrame:
    return rdf.select("label", F.col("radius").alias("x"), F.col("rdf").alias("y"), "integral")


def angular_plot(angular: DataFrame) -> DataFrame:
    """Labels name the centre atom in the middle."""
    parts = F.split("label", "_", -1)
    label = F.when(F.size(parts) == 3, F.concat_ws("-", parts[1], parts[0], parts[2])).otherwise(F.col("label"))
    return angular.select(label.alias("label"), F.col("angle").alias("x"), F.col("value").alias("y"))


def _power(v: Column) -> Column:
    return F.floor(F.log10(F.abs(v))).cast("int")


def scientific(value: Column, decimals: int = 2) -> Column:
    r"""``1.23 \cdot 10^{-5}``."""
    e = _power(value)
    return F.format_string(rf"%.{decimals}f \cdot 10^{{%d}}", value / F.pow(F.lit(10.0), e), e)


def mean_with_error(mean: Column, error: Column, decimals: int = 2) -> Column:
    r"""``\left(1.23 \pm 0.10 \right)\cdot 10^{-5}``, or two powers if they differ; without an error only the mean; N/A without a mean."""
    sem = F.when(F.isnan(error), F.lit(None)).otherwise(error)
    m, s = [F.format_string(f"%.{decimals}e", v).cast("double") for v in (mean, sem)]
    em, es = _power(m), _power(s)
    pm, ps = m / F.pow(F.lit(10.0), em), s / F.pow(F.lit(10.0), es)
    f = f"%.{decimals}f"
    alone = F.format_string(rf"{f}\cdot 10^{{%d}}", pm, em)
    both = F.when(em == es, F.format_string(rf"\left({f} \pm {f} \right)\cdot 10^{{%d}}", pm, ps, em)).otherwise(F.format_string(rf"{f} \cdot 10^{{%d}} \pm {f} \cdot 10^{{%d}}", pm, em, ps, es))
    return F.when(mean.isNull() | F.isnan(mean), "N/A").when(sem.isNull(), alone).otherwise(both)
