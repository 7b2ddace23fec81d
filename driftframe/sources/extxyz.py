"""Extended XYZ files, and coordinate blocks of a fixed number of lines."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.functions.constants import BOHR_IN_ANGSTROM, NUMBERS
from driftframe.model import Trajectory, atoms_of_types, inline, small
from driftframe.sources.text import number, numbered, running_total, words, write_single

_PROPERTIES = re.compile(r'Properties=("?)(\S+?)\1(?:\s|$)')
_NAMES = {"species": ("symbol",), "pos": G.AXES, "velo": ("vx", "vy", "vz"), "vel": ("vx", "vy", "vz"), "velocities": ("vx", "vy", "vz"), "forces": ("fx", "fy", "fz"), "force": ("fx", "fy", "fz")}


def blocks(spark: SparkSession, path: str, head: int, nat: int) -> DataFrame:
    """(step, row, w): the words of each line of blocks of ``head`` + ``nat`` lines; a block that the file cuts short is left out."""
    size = head + nat
    lines = numbered(spark, path)
    last = lines.where(F.trim("value") != "").agg(F.max("line")).first()[0]
    whole = 0 if last is None else (last + 1) // size
    step = F.floor(F.col("line") / size)
    return lines.where(step < whole).select(step.alias("step"), (F.col("line") % size).cast("int").alias("row"), words("value").alias("w"), "value")


def _varying(spark: SparkSession, path: str, width: int, symbol: int, ident: int) -> tuple[DataFrame, DataFrame]:
    """Of frames of any number of lines: (step, value) of the comment lines, which all name Properties, and (step, id, symbol, w) of the atoms.

    A last frame that the file cuts short is left out.
    """
    comment = F.col("value").contains("Properties=")
    lines = running_total(numbered(spark, path), comment.cast("int"), "before").withColumn("w", words("value"))
    comments = lines.where(comment).select(F.col("before").alias("step"), "value")
    heads = lines.where(~comment & (F.size("w") == 1))
    last = heads.agg(F.max("before").alias("step"), F.max("line").alias("line"), F.max_by(F.get("w", F.lit(0)), "line").cast("int").alias("n"), F.countDistinct("before").alias("steps"), F.count("*").alias("heads")).first()
    end = lines.where((F.col("line") > last.line) & (F.size("w") > 0)).agg(F.count("*").alias("lines"), F.count_if(comment).alias("comments"), F.count_if(~comment & (F.size("w") >= width)).alias("atoms")).first()
    if not last.heads == last.steps == last.step + 1 or end.lines > 1 and not end.comments:
        raise ValueError(f"{path}: frames whose comment lines don't name Properties")
    whole = bool(end.comments) and end.atoms >= last.n
    kept = F.lit(True) if whole else F.col("line") < last.line
    body = lines.where(kept & ~comment & (F.size("w") > 1)).select((F.col("before") - 1).alias("step"), F.get("w", F.lit(ident)).cast("long").alias("id"), F.get("w", F.lit(symbol)).alias("symbol"), "w")
    return comments.where(F.col("step") < last.step + whole), body


def read_extxyz(spark: SparkSession, path: str, timestep_fs: float = 1.0, partial: bool = False) -> Trajectory:
    """Frames of one constant set of atoms, which are ordered by atomic number, ties as in the file.

    Lattice="..." of the comment lines gives the cells. Velocities and forces are read as they are.
    With ``partial`` frames may lack atoms: a column id tells the atoms, and ties are ordered by it.
    """
    top = {r.line: r.value for r in numbered(spark, path).where("line < 2").collect()}
    nat, comment = int(top[0]), top[1]
    found = _PROPERTIES.search(comment)
    fields = (found[2] if found else "species:S:1:pos:R:3").split(":")
    at, place = {}, 0
    for name, width in zip(fields[::3], map(int, fields[2::3])):
        names = _NAMES.get(name) or ((name,) if width == 1 else tuple(f"{name}{i}" for i in range(width)))
        at |= {n: place + i for i, n in enumerate(names)}
        place += width
    if partial:
        if "id" not in at:
            raise ValueError(f"{path}: frames that lack atoms need a column id")
        comments, body = _varying(spark, path, place, at["symbol"], at.pop("id"))
        seen = sorted((NUMBERS.get(r.symbol, 0), r.id, r.symbol) for r in body.select("id", "symbol").distinct().collect())
        if len({i for _, i, _ in seen}) < len(seen):
            raise ValueError(f"{path}: an id has several species")
        symbols, order = [s for _, _, s in seen], range(len(seen))
        body = body.join(small(inline(spark, [(k, i) for k, (_, i, _) in enumerate(seen)], "atom_idx int, id long"), len(seen)), "id")
    else:
        rows = blocks(spark, path, 2, nat)
        comments, body = rows.where("row = 1"), rows.where("row >= 2")
        symbols = [r.s for r in body.where("step = 0").orderBy("row").select(F.get("w", F.lit(at["symbol"])).alias("s")).collect()]
        order = sorted(range(nat), key=lambda i: NUMBERS.get(symbols[i], 0))
        place_of = F.array(*[F.lit(order.index(i)) for i in range(nat)]) if nat <= 1000 else None
        if place_of is None:
            table = spark.createDataFrame([(2 + old, new) for new, old in enumerate(order)], "row int, atom_idx int")
            body = body.join(small(table, nat), "row")
        else:
            body = body.withColumn("atom_idx", F.get(place_of, F.col("row") - 2))
    kinds = dict(zip(fields[::3], fields[1::3]))
    columns = {n: number(F.get("w", F.lit(i))) for n, i in at.items() if n != "symbol" and kinds.get(n, "R") in "RI"}
    traj_id = F.lit(0).alias("traj_id")
    frames = body.select(traj_id, "step", F.col("atom_idx").cast("int"), *[c.alias(n) for n, c in columns.items()])
    cells = None
    if "Lattice=" in comment:
        lattice = words(F.regexp_extract("value", r'Lattice="([^"]*)"', 1))
        cells = comments.select(traj_id, "step", *[number(F.get(lattice, F.lit(i))).alias(n) for i, n in enumerate(G.CELL)])
    return Trajectory(frames, atoms_of_types(spark, [symbols[i] for i in order]), timestep_fs, None, cells)


def write_extxyz(traj: Trajectory, path: str, partial: bool = False) -> None:
    """One file, frames in order, with positions, velocities and forces where they are, and with ids from 1 if steps may lack atoms (``partial``)."""
    groups = [(n, c) for n, c in (("pos", G.AXES), ("velo", ("vx", "vy", "vz")), ("forces", ("fx", "fy", "fz"))) if set(c) <= set(traj.frames.columns)]
    properties = "species:S:1:" + ":".join(f"{n}:R:3" for n, _ in groups) + ":id:I:1" * partial
    columns = [c for _, names in groups for c in names]
    rows = traj.frames.join(small(traj.atoms.select("traj_id", "atom_idx", "type"), traj.nat), ["traj_id", "atom_idx"])
    body = rows.select("traj_id", "step", (F.col("atom_idx") + 2).alias("row"), F.concat_ws(" ", F.rpad("type", 2, " "), *[F.format_string("%20.12f", c) for c in columns], *([F.col("atom_idx") + 1] if partial else [])).alias("value"))
    per_step = traj.with_cell(traj.frames.groupBy("traj_id", "step").agg(F.count("*").alias("n"))) if traj.cell or traj.cells is not None else traj.frames.groupBy("traj_id", "step").agg(F.count("*").alias("n"))
    lattice = F.concat(F.lit('Lattice="'), F.concat_ws(" ", *[G.column(v).cast("string") for row in traj.cell_columns() for v in row]), F.lit('" ')) if traj.cell or traj.cells is not None else F.lit("")
    heads = per_step.select("traj_id", "step", F.explode(F.array(F.struct(F.lit(0).alias("row"), F.col("n").cast("string").alias("value")), F.struct(F.lit(1).alias("row"), F.concat(lattice, F.lit(f"Properties={properties}")).alias("value")))).alias("h"))
    write_single(heads.select("traj_id", "step", "h.*").union(body), path, ["traj_id", "step", "row"])


def read_cp_positions(spark: SparkSession, path: str, nat: int, bohr: bool = True) -> tuple[DataFrame, float]:
    """(step, atom_idx, x, y, z in Angstrom) of a file of blocks with one head line, and the timestep in fs of the first two heads (in ps)."""
    rows = blocks(spark, path, 1, nat)
    factor = BOHR_IN_ANGSTROM if bohr else 1.0
    heads = [float(r.t) for r in rows.where("row = 0 and step < 2").orderBy("step").select(F.get("w", F.lit(1)).alias("t")).collect()]
    table = rows.where("row > 0").select("step", (F.col("row") - 1).alias("atom_idx"), *[(number(F.get("w", F.lit(i))) * factor).alias(a) for i, a in enumerate(G.AXES)])
    return table, abs(heads[1] - heads[0]) * 1000 if len(heads) > 1 else 0.0


def read_start_positions(spark: SparkSession, path: str) -> DataFrame:
    """(atom_idx, type, x, y, z in Angstrom) of the ATOMIC_POSITIONS card of an input file; lines that start with # are skipped."""
    lines = numbered(spark, path, single=True)
    marks = lines.where(F.lower("value").rlike(r"^\s*(nat\s*=|atomic_positions)")).collect()
    nat = next(int(re.search(r"=\s*(\d+)", r.value)[1]) for r in marks if "=" in r.value)
    card = next(r for r in marks if "=" not in r.value)
    factor = BOHR_IN_ANGSTROM if re.search(r"\(?bohr\)?\s*$", card.value.strip(), re.I) else 1.0
    body = lines.where((F.col("line") > card.line) & ~F.startswith("value", F.lit("#"))).withColumn("w", words("value")).where(F.size("w") >= 4)
    order = Window.partitionBy(F.lit(0)).orderBy("line")
    body = body.orderBy("line").limit(nat)  # the card holds nat lines
    return body.select((F.row_number().over(order) - 1).alias("atom_idx"), F.get("w", F.lit(0)).alias("type"), *[(number(F.get("w", F.lit(1 + i))) * factor).alias(a) for i, a in enumerate(G.AXES)])


def read_forces(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    """(nth, symbol, values): the lines "SYM v1 v2 ..." of these symbols, numbered from 0 in file order."""
    pattern = r"^[ \t]*([A-Za-z]+[A-Za-z0-9]*)((?:\s+[-+]?(?:\d*\.\d+|\d+\.?\d*)(?:[eE][-+]?\d+)?)+)\s*$"
    lines = numbered(spark, path, single=True).where(F.col("value").rlike(pattern) & F.regexp_extract("value", pattern, 1).isin(symbols))
    counted = running_total(lines, F.lit(1), "nth")
    return counted.select("nth", F.regexp_extract("value", pattern, 1).alias("symbol"), F.transform(words(F.regexp_extract("value", pattern, 2)), number).alias("values"))


def force_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b row by row; values that a lacks are 0, values that b lacks raise."""
    joined = a.join(b.select("nth", F.col("values").alias("other")), "nth")
    size = F.size("other")
    given = F.when(F.size("values") > size, F.raise_error(F.lit("the second file has fewer columns"))).otherwise(F.col("values"))
    return joined.select("nth", "symbol", F.zip_with(given, "other", lambda x, y: F.coalesce(x, F.lit(0.0)) - y).alias("values"))


def shifted(traj: Trajectory, by: tuple[float, float, float]) -> Trajectory:
    """All positions moved by a vector."""
    return replace(traj, frames=traj.frames.withColumns({a: F.col(a) + F.lit(float(v)) for a, v in zip(G.AXES, by)}))
