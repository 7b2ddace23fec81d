"""Molecular-dynamics dump files and thermo tables.

A dump is read as one record per frame (records end where the next frame's header starts), so splits
are aligned to frames; a frame is parsed, sorted by atom id and unrolled within its row, without a
shuffle. A frame must fit in one row (2 GB of text).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.functions.constants import ELEMENTS
from driftframe.model import Trajectory, atoms_of_types, inline, small
from driftframe.sources.text import NUMBER, number, numbered, words

_SEPARATOR = "ITEM: TIMESTEP\n"
_STYLES = (("xu", "yu", "zu"), ("xs", "ys", "zs"), ("x", "y", "z"))


class DumpError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    """What the first frame's header says: timestep, atoms, cell, columns by name."""

    timestep: int
    nat: int
    cell: tuple[tuple[float, ...], ...]
    columns: tuple[str, ...]

    @property
    def positions(self) -> tuple[str, tuple[str, str, str]]:
        """(style, column names): unwrapped, else scaled, else plain."""
        for style in _STYLES:
            if set(style) <= set(self.columns):
                return style[0][1:] or "plain", style
        if {"xsu", "ysu", "zsu"} <= set(self.columns):
            raise NotImplementedError("scaled unwrapped positions (xsu ysu zsu)")
        raise DumpError(f"no positions among {self.columns}")

    def vector(self, prefix: str) -> tuple[str, ...] | None:
        names = tuple(f"{prefix}{a}" for a in G.AXES)
        return names if set(names) <= set(self.columns) else None


def read_header(frame: str) -> Header:
    """Parses one frame (without the line ``ITEM: TIMESTEP``)."""
    lines = frame.split("\n", 8)
    if len(lines) < 8 or not lines[1].startswith("ITEM: NUMBER OF ATOMS") or not lines[7].startswith("ITEM: ATOMS"):
        raise DumpError("not a dump file")
    box = [[float(v) for v in re.findall(NUMBER, line)] for line in lines[4:7]]
    bounds = lines[3].removeprefix("ITEM: BOX BOUNDS").split()
    if bounds == ["pp"] * 3 and all(len(b) == 2 for b in box):
        tilt = (0.0, 0.0, 0.0)
    elif bounds == ["xy", "xz", "yz", *["pp"] * 3] and all(len(b) == 3 for b in box):
        tilt = tuple(b[2] for b in box)
    else:
        raise DumpError(f"unsupported box {lines[3]!r}")
    a, b, c = (hi - lo for lo, hi, *_ in box)
    cell = ((a, 0.0, 0.0), (tilt[0], b, 0.0), (tilt[1], tilt[2], c))
    return Header(int(lines[0]), int(lines[2]), cell, tuple(lines[7].removeprefix("ITEM: ATOMS").split()))


def _cell_columns(lines: Column, correct_tilt: bool) -> list[Column]:
    box = [F.transform(words(F.get(lines, F.lit(4 + i))), number) for i in range(3)]
    lo, hi = [F.get(b, F.lit(0)) for b in box], [F.get(b, F.lit(1)) for b in box]
    xy, xz, yz = [F.coalesce(F.get(b, F.lit(2)), F.lit(0.0)) for b in box]
    zero = F.lit(0.0)
    if correct_tilt:  # bounds of a tilted box are those of what encloses it
        lo[0], hi[0] = lo[0] - F.least(zero, xy, xz, xy + xz), hi[0] - F.greatest(zero, xy, xz, xy + xz)
        lo[1], hi[1] = lo[1] - F.least(zero, yz), hi[1] - F.greatest(zero, yz)
    a, b, c = [h - low for h, low in zip(hi, lo)]
    return [a, zero, zero, xy, b, zero, xz, yz, c]


def read_frames(spark: SparkSession, path: str, skip: int = 0, istep: int = 1, correct_tilt: bool = False, partial: bool = False) -> tuple[Header, DataFrame]:
    """The header of the first frame, and (step, raw_timestep, ax..cz, rows) per frame used, of one dump file or of several in order.

    Frames are those with number >= skip that ``istep`` divides, numbered anew from 0. From the first
    frame on whose number of atoms differs, frames are left out; ``partial`` keeps those that have as
    many rows as they say.
    """
    records = numbered(spark, path, _SEPARATOR)
    first = records.where("line = 0").select("value").first()
    if first is None:
        raise DumpError(f"{path}: no frame")
    header = read_header(first.value)
    lines = F.split("value", "\n", -1)
    nat = F.regexp_extract(F.get(lines, F.lit(2)), r"\d+", 0)
    frames = records.select(F.col("line").alias("frame"), lines.alias("lines"), nat.cast("int").alias("nat"))
    other = F.col("nat").isNull() if partial else ~F.col("nat").eqNullSafe(F.lit(header.nat))
    last = words(F.get("lines", 7 + F.col("nat")))
    bad = frames.where(other | (F.coalesce(F.size(last), F.lit(0)) < len(header.columns))).agg(F.min("frame")).first()[0]
    good = frames if bad is None else frames.where(F.col("frame") < bad)
    used = good.where((F.col("frame") >= skip) & (F.col("frame") % istep == 0))
    start = -(-skip // istep)
    cells = [c.alias(n) for c, n in zip(_cell_columns(F.col("lines"), correct_tilt), G.CELL)]
    raw = F.trim(F.get("lines", F.lit(0))).cast("long")
    return header, used.select((F.col("frame") / istep - start).cast("long").alias("step"), raw.alias("raw_timestep"), *cells, F.slice("lines", F.lit(9), F.col("nat")).alias("rows"))


def resolve_types(header: Header, first: Sequence[Sequence[str]], elements: Sequence[str] | None = None, elements_file: str | None = None, types: Sequence[str] | None = None, mass_types: Mapping[int, float] | None = None) -> list[str]:
    """Symbols of the atoms in id order.

    By precedence: ``types`` as given, the column ``element``, ``elements`` by type number, the file's first
    line likewise, the element nearest in mass to ``mass_types`` of the type number; else all H.
    """
    if types is not None:
        if len(types) != header.nat:
            raise DumpError(f"{len(types)} types for {header.nat} atoms")
        return list(types)
    if "element" in header.columns:
        at = header.columns.index("element")
        return [r[at] for r in first]
    if elements_file is not None and elements is None:
        with open(elements_file) as f:
            elements = f.read().split()
    if elements is None and mass_types is None:
        return ["H"] * header.nat
    if "type" not in header.columns:
        raise DumpError("the dump has no column type")
    at = header.columns.index("type")
    if elements is not None:
        return [elements[int(r[at]) - 1] for r in first]
    near = {t: min(ELEMENTS, key=lambda e, m=m: abs(e[2] - m))[0] for t, m in mass_types.items()}
    return [near[int(r[at])] for r in first]


def nearest_element(masses: DataFrame, column: str = "mass") -> DataFrame:
    """``masses`` with ``symbol``, the element of nearest mass (ties: the lighter): a minimum over the 118 elements within the row."""
    table = F.array(*[F.struct(F.abs(F.col(column) - F.lit(m)).alias("off"), F.lit(z).alias("z"), F.lit(s).alias("s")) for s, z, m in ELEMENTS])
    return masses.withColumn("symbol", F.array_min(table)["s"])


def read_dump(
    spark: SparkSession, path: str, elements: Sequence[str] | None = None, elements_file: str | None = None, types: Sequence[str] | None = None,
    timestep: float | None = None, mass_types: Mapping[int, float] | None = None, thermo_file: str | None = None, thermo_pe: str | None = None,
    thermo_stress: Sequence[str] | None = None, thermo_keywords: Sequence[str] = (), ignore_forces: bool = False, ignore_velocities: bool = False,
    skip: int = 0, f_conv: float = 1.0, e_conv: float = 1.0, s_conv: float = 1.0, additional_columns: Sequence[str] = (), istep: int = 1, correct_tilt: bool = False, partial: bool = False,
) -> Trajectory:
    """A dump file, or a folder of them, as a Trajectory with cells, and, from a thermo file, energies, stress and other columns per step.

    Scaled positions are multiplied by the cell; nothing is unwrapped or moved by the box's origin;
    velocities have no factor. ``timestep`` is that between the frames used, in fs. With ``partial`` frames
    may lack atoms: the atoms are all ids of the frames used, and a frame has rows of those it holds.
    """
    header, frames = read_frames(spark, path, skip, istep, correct_tilt, partial)
    style, names = header.positions
    if missing := [c for c in additional_columns if c not in header.columns]:
        raise DumpError(f"no columns {missing}")
    at = {c: i for i, c in enumerate(header.columns)}
    if "id" not in at:
        raise DumpError("the dump has no column id")
    parsed = F.array_sort(F.transform("rows", lambda line: F.struct(F.get(words(line), F.lit(at["id"])).cast("long").alias("id"), words(line).alias("w"))))
    rows = frames.select("step", "raw_timestep", *G.CELL, F.posexplode(parsed).alias("atom_idx", "row"))
    if partial:
        rows, first = _by_id(rows, header.nat)
        header = replace(header, nat=len(first))
    else:
        first = frames.orderBy("step").limit(1).select(F.transform(parsed, lambda r: r["w"]).alias("w")).first()
        first = first and first.w
    value = lambda c: number(F.get(F.col("row.w"), F.lit(at[c])))
    position = [value(n) for n in names]
    if style == "s":
        position = G.times(position, G.cell_of())
    columns = dict(zip(G.AXES, position))
    if not ignore_velocities and (v := header.vector("v")):
        columns |= dict(zip(("vx", "vy", "vz"), map(value, v)))
    if not ignore_forces and (f := header.vector("f")):
        columns |= {c: value(n) * f_conv for c, n in zip(("fx", "fy", "fz"), f)}
    columns |= {c: value(c) for c in additional_columns}
    zero = F.lit(0).alias("traj_id")
    table = rows.select(zero, "step", F.col("atom_idx").cast("int"), *[c.alias(n) for n, c in columns.items()])
    if not first:
        raise DumpError(f"{path}: no frame left")
    symbols = resolve_types(header, first, elements, elements_file, types, mass_types)
    steps = frames.select(zero, "step", "raw_timestep")
    if thermo_file is not None:
        steps = with_thermo(steps, read_thermo(spark, thermo_file), thermo_pe, thermo_stress, thermo_keywords, e_conv, s_conv)
    return Trajectory(table, atoms_of_types(spark, symbols), timestep or 1.0, None, frames.select(zero, "step", *G.CELL), steps)


def _by_id(rows: DataFrame, nat: int) -> tuple[DataFrame, list[list[str]]]:
    """``rows`` with atoms numbered by the order of all ids, and each atom's words in the first frame that has it; a row for each atom reaches the driver."""
    rows = rows.withColumn("id", F.col("row.id"))
    seen = small(rows.groupBy("id").agg(F.min("step").alias("step")), nat)
    first = sorted(rows.join(seen, ["id", "step"]).select("id", "row.w").collect())
    table = inline(rows.sparkSession, [(i, r.id) for i, r in enumerate(first)], "atom_idx int, id long")
    return rows.drop("atom_idx").join(small(table, len(first)), "id"), [r.w for r in first]


def read_thermo(spark: SparkSession, path: str) -> DataFrame:
    """A thermo table: line 1 is skipped, line 2 starts with # and names the columns; of a repeated first column the first row stays."""
    rows = numbered(spark, path, single=True)
    head = rows.where("line = 1").first()
    if head is None or not head.value.lstrip().startswith("#"):
        raise DumpError(f"{path}: the second line names no columns")
    names = head.value.lstrip().removeprefix("#").split()
    cells = rows.where("line > 1").select("line", words("value").alias("w")).where(F.size("w") > 0)
    data = cells.select("line", *[number(F.get("w", F.lit(i))).alias(n) for i, n in enumerate(names)])
    return first_of(data.withColumn(names[0], F.col(f"`{names[0]}`").cast("long")), names[0], "line").drop("line")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the least ``order`` of each ``key``: an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    picked = F.min(F.struct(F.col(f"`{order}`"), *[F.col(f"`{c}`") for c in rest if c != order])).alias("__row")
    return rows.groupBy(F.col(f"`{key}`")).agg(picked).select(f"`{key}`", *[F.col("__row").getField(c).alias(c) for c in rest])


def with_thermo(steps: DataFrame, thermo: DataFrame, pe: str | None = None, stress: Sequence[str] | None = None, keywords: Sequence[str] = (), e_conv: float = 1.0, s_conv: float = 1.0) -> DataFrame:
    """``steps`` (raw_timestep) with energies, stress and other columns of the thermo table; a step without a row raises when read."""
    key = thermo.columns[0]
    if stress is not None and len(stress) != 6:
        raise ValueError("thermo_stress takes six columns: xx yy zz yz xz xy")
    wanted = [*([pe] if pe else []), *(stress or ()), *keywords]
    if bad := [c for c in wanted if c not in thermo.columns]:
        raise DumpError(f"the thermo table has no {bad}; it has {thermo.columns}")
    columns = {}
    if pe:
        columns["potential_energy"] = F.col(f"__t.`{pe}`") * e_conv
    if stress:
        columns |= {n: F.col(f"__t.`{c}`") * s_conv for n, c in zip(("sxx", "syy", "szz", "syz", "sxz", "sxy"), stress)}
    columns |= {c: F.col(f"__t.`{c}`") for c in keywords}
    keyed = thermo.select(F.col(f"`{key}`").alias("raw_timestep"), F.struct(*[F.col(f"`{c}`") for c in thermo.columns]).alias("__t"))
    joined = steps.join(keyed, "raw_timestep", "left")
    lost = F.when(F.col("__t").isNull(), F.raise_error(F.concat(F.lit("no thermo row for timestep "), F.col("raw_timestep").cast("string"))))
    return joined.where(lost.isNull()).select(*steps.columns, *[c.alias(n) for n, c in columns.items()])
