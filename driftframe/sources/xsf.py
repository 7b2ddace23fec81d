"""XSF grid files: atoms, cell and a periodic scalar field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.functions.constants import XSF_BOHR_IN_ANGSTROM
from driftframe.operators.grid import dense, padded
from driftframe.sources.text import number, numbered, running_total, words, wrapped_lines, write_single

_HEAD = r"(?i)^\s*(PRIMVEC|PRIMCOORD|DATAGRID_3D_\S+|BEGIN_DATAGRID_3D\S*|END_DATAGRID_3D)"


class XsfError(ValueError):
    pass


@dataclass(frozen=True)
class Xsf:
    """``grid`` (ix, iy, iz, value) without the padding planes, ``atoms`` (atom_idx, type, x, y, z), cell in Angstrom."""

    grid: DataFrame
    shape: tuple[int, int, int]
    atoms: DataFrame
    cell: tuple[tuple[float, ...], ...]

    @property
    def volume_ang(self) -> float:
        """Signed."""
        return G.det(self.cell)

    @property
    def volume_au(self) -> float:
        return self.volume_ang / XSF_BOHR_IN_ANGSTROM**3

    def total_charge(self) -> DataFrame:
        """One row: the integral of the field over the cell, volume in atomic units."""
        points = self.shape[0] * self.shape[1] * self.shape[2]
        return self.grid.agg((F.sum("value") * F.lit(self.volume_au / points)).alias("charge"))


def read_xsf(spark: SparkSession, path: str, fold_positions: bool = False) -> Xsf:
    """Header lines are collected (three cell rows, sizes); atoms and values stay distributed.

    The file's dimensions are n + 1; values run along x first, and those of the last plane of each axis
    are dropped. A file without a grid raises.
    """
    lines = numbered(spark, path, single=True)
    marks = [(r.line, r.value.split()[0].upper()) for r in lines.where(F.col("value").rlike(_HEAD)).orderBy("line").collect()]
    at = {word.split("_3D")[0]: line for line, word in reversed(marks)}
    start = at.get("DATAGRID", at.get("BEGIN_DATAGRID"))
    if start is None or "PRIMVEC" not in at:
        raise XsfError(f"{path}: no grid or no cell")
    end = min((line for line, word in marks if word.startswith("END_DATAGRID") and line > start), default=None)
    wanted = [at["PRIMVEC"] + k for k in (1, 2, 3)] + [start + 1] + ([at["PRIMCOORD"] + 1] if "PRIMCOORD" in at else [])
    found = {r.line: r.value.split() for r in lines.where(F.col("line").isin(wanted)).collect()}
    cell = tuple(tuple(map(float, found[at["PRIMVEC"] + k])) for k in (1, 2, 3))
    dims = tuple(map(int, found[start + 1][:3]))
    nat = int(found[at["PRIMCOORD"] + 1][0]) if "PRIMCOORD" in at else 0
    first = at.get("PRIMCOORD", -1) + 2
    w = words("value")
    atoms = lines.where((F.col("line") >= first) & (F.col("line") < first + nat)).select((F.col("line") - first).cast("int").alias("atom_idx"), F.get(w, F.lit(0)).alias("type"), *[number(F.get(w, F.lit(1 + i))).alias(a) for i, a in enumerate(G.AXES)])
    if fold_positions:
        atoms = atoms.select("atom_idx", "type", *[c.alias(a) for c, a in zip(G.folded(G.vector(*G.AXES), G.constant_cell(cell)), G.AXES)])
    body = lines.where((F.col("line") > start + 5) & (F.col("line") < F.lit(end if end is not None else 1 << 62)))
    counted = running_total(body.withColumn("w", w), F.size("w"), "before")
    values = counted.select((F.posexplode("w")), "before").select((F.col("before") + F.col("pos")).alias("nth"), number("col").alias("value"))
    nx, ny, nz = dims
    n = F.col("nth")
    grid = values.select((n % nx).cast("int").alias("ix"), (F.floor(n / nx) % ny).cast("int").alias("iy"), F.floor(n / (nx * ny)).cast("int").alias("iz"), "value")
    inside = (F.col("ix") < nx - 1) & (F.col("iy") < ny - 1) & (F.col("iz") < nz - 1)
    return Xsf(grid.where(inside), (nx - 1, ny - 1, nz - 1), atoms, cell)


def header(cell: Sequence[Sequence[float]], atoms: Sequence[tuple], shape: Sequence[int]) -> list[str]:
    """Lines before the values; ``atoms`` are (symbol, x, y, z)."""
    rows = ["    " + "    ".join(f"{v:.9f}" for v in row) for row in cell]
    places = [f"{s:<3}     " + "   ".join(f"{v:.9f}" for v in p) for s, *p in atoms]
    size = "         ".join(str(n + 1) for n in shape)
    return [" CRYSTAL", " PRIMVEC", *rows, "PRIMCOORD", f"       {len(atoms)}        1", *places, "BEGIN_BLOCK_DATAGRID_3D", "3D_PWSCF", "DATAGRID_3D_UNKNOWN", f"         {size}", "  0.000000  0.000000  0.000000", *rows]


def _numbered_values(grid: DataFrame, shape: Sequence[int]) -> DataFrame:
    nx, ny, _ = shape
    return grid.select((F.col("ix") + nx * (F.col("iy") + F.lit(ny).cast("long") * F.col("iz"))).alias("nth"), "value")


def _write(spark: SparkSession, head: list[str], values: DataFrame, per_line: int, form: str, path: str, tail: list[str]) -> None:
    body = wrapped_lines(values, F.format_string(form, "value"), per_line).select(F.lit(1).alias("part"), F.col("row").cast("long"), "value")
    ends = spark.createDataFrame([(p, i, v) for p, lines in ((0, head), (2, tail)) for i, v in enumerate(lines)], "part int, row long, value string")
    write_single(ends.union(body), path, ["part", "row"])


def write_xsf(grid: DataFrame, shape: Sequence[int], cell: Sequence[Sequence[float]], atoms: Sequence[tuple], path: str, vals_per_line: int = 6, is_flattened: bool = False, fixed_point: bool = False) -> None:
    """Writes a grid (points it lacks are 0), padded to n + 1 along each axis, x first.

    Values are written as 0.1234E+00, with ``fixed_point`` in 20 columns with 10 decimals. ``is_flattened``
    writes them unpadded although the header says n + 1.
    """
    whole = dense(grid, shape)
    values = _numbered_values(whole, shape) if is_flattened else _numbered_values(padded(whole, shape), [n + 1 for n in shape])
    _write(grid.sparkSession, header(cell, atoms, shape), values, vals_per_line, "%20.10f" if fixed_point else "  %.4E", path, ["END_DATAGRID_3D", "END_BLOCK_DATAGRID_3D"])


def write_grid(grid: DataFrame, shape: Sequence[int], path: str, vals_per_line: int = 5) -> None:
    """Unpadded values under one header line of the padded sizes; a line holds one more than ``vals_per_line``."""
    head = ["3" + " " + "         ".join(str(n + 1) for n in shape)]
    _write(grid.sparkSession, head, _numbered_values(dense(grid, shape), shape), vals_per_line + 1, "  %.4E", path, [])


def write_rdf_table(rdf: DataFrame, path: str) -> None:
    """``radius rdf integral`` rows of one label under a header line."""
    spark = rdf.sparkSession
    body = rdf.select(F.col("bin").cast("long").alias("row"), F.format_string("%.8e %.8e %.8e", "radius", "rdf", "integral").alias("value"))
    write_single(spark.createDataFrame([(-1, "# radius rdf integral")], "row long, value string").union(body), path, ["row"])
