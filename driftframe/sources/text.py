"""Distributed reading of text files whose order matters, and single-file text sinks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eEdD][-+]?\d+)?"


def words(line: str | Column) -> Column:
    """White-space separated words; none for a blank line."""
    trimmed = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " ", -1))


def number(text: Column) -> Column:
    """A double; Fortran exponents (D) too. What is no number is null: filters may be moved below this, so it can't raise."""
    return F.translate(text, "dD", "eE").try_cast("double")


def _in_order(path: str) -> list:
    """Sort key of file names: runs of digits count as numbers."""
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.split(r"(\d+)", path) if x]


def numbered(spark: SparkSession, path: str, separator: str | None = None, single: bool = False) -> DataFrame:
    """(line, value, split) of a text file, or of several (a folder or pattern) one after the other, lines numbered from 0.

    Files are in the order of their names, numbers in them by value. With a ``separator`` the records between
    it are numbered, without empty ones. ``single`` refuses more than one file. Each task numbers the lines of
    its splits; only the splits' line counts, a row for each, reach the driver to become offsets. No sort and
    no single task.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"))
    if separator is not None:
        rows = rows.where(F.length("value") > 0)
    rows = rows.withColumn("__nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    offsets, total = [], 0
    found = rows.groupBy("__file", "__at").agg(F.count("*").alias("n"), F.min("__nth").alias("low")).collect()
    for split, r in enumerate(sorted(found, key=lambda r: (_in_order(r["__file"]), r["__at"]))):
        offsets.append((r["__file"], r["__at"], total - r.low, split))
        total += r.n
    if single and len({r["__file"] for r in found}) > 1:
        raise ValueError(f"{path}: more than one file")
    table = spark.createDataFrame(offsets, "__file string, __at long, __from long, split long")
    return rows.join(F.broadcast(table), ["__file", "__at"]).select((F.col("__nth") + F.col("__from")).alias("line"), "value", "split")


def running_total(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """``rows`` of ``numbered`` with the sum of ``amount`` over all lines before each line.

    Sums run within a split; the splits' totals, a row for each, become offsets on the driver.
    """
    rows = rows.withColumn("__amount", amount)
    offsets, total = [], 0
    for r in sorted(rows.groupBy("split").agg(F.sum("__amount").alias("n")).collect(), key=lambda r: r.split):
        offsets.append((r.split, total))
        total += r.n
    table = rows.sparkSession.createDataFrame(offsets, "split long, __from long")
    before = Window.partitionBy("split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(table), "split")
    return out.withColumn(name, F.coalesce(F.sum("__amount").over(before), F.lit(0)) + F.col("__from")).drop("__amount", "__from")


def write_single(lines: DataFrame, path: str, order: list[str]) -> None:
    """Writes column ``value`` of ``lines`` as one text file at ``path``, ordered.

    Tasks write the sorted partitions side by side, a file each; their bytes are then copied one after the other through a small buffer.
    """
    spark = lines.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    lines.orderBy(*order).select("value").write.option("compression", "none").text(folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(conf)
    parts = sorted((f.getPath() for f in store.listStatus(place(folder)) if f.getPath().getName().startswith("part-")), key=lambda p: _in_order(p.getName()))
    whole = parts[0] if len(parts) == 1 else place(f"{folder}/whole")
    if len(parts) != 1:
        out = store.create(whole)
        try:
            for part in parts:
                source = store.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
                store.delete(part, False)
        finally:
            out.close()
    target = place(path)
    store.delete(target, False)
    store.rename(whole, target)
    store.delete(place(folder), True)


def wrapped_lines(values: DataFrame, text: Column, per_line: int) -> DataFrame:
    """(row, value): the texts of ``values`` (``nth`` from 0) joined ``per_line`` to a line."""
    rows = values.select(F.floor(F.col("nth") / per_line).alias("row"), F.struct("nth", text.alias("t")).alias("s"))
    return rows.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "").alias("value"))
