"""Pair and triple distributions within a step, under periodic boundaries.

Pairs are found through a grid of cells at least ``radius`` wide: an atom meets the atoms of its own and
the adjacent cells only, so work grows with the atoms, not with their square. Axes too short for three
cells have one. Two atoms as near as ``radius`` through any lattice vector lie in adjacent cells, hence
no pair is lost whichever image rule then gives the distance.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftframe.functions import geometry as G
from driftframe.model import Trajectory, inline, small
from driftframe.params import InputError

Spec = str | int | Sequence


def frames_between(traj: Trajectory, istart: int, istop: int | None, stepsize: int) -> tuple[DataFrame, dict[int, int]]:
    """Frames istart, istart + stepsize, ... below istop, and how many there are of each trajectory."""
    counts = {}
    for t, n in traj.nsteps.items():
        if istop is not None and istop >= n:
            raise InputError(f"istop {istop} is beyond the last of {n} steps")
        counts[t] = max(0, -(-((n if istop is None else istop) - istart) // stepsize))
    return traj.slice_steps(istart, istop, stepsize), counts


def spec_label(spec: Spec, number: int) -> str:
    return spec if isinstance(spec, str) else str(spec) if isinstance(spec, int) else f"spec_{number}"


def _chosen(spec: Spec) -> Column:
    if isinstance(spec, str):
        return F.col("type") == spec
    if isinstance(spec, int):
        return F.col("atom_idx") == spec
    test = F.lit(False)
    for s in spec:
        test = test | _chosen(s)
    return test


def default_pairs(species: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(sorted(species), 2))


@dataclass(frozen=True)
class Lattice:
    """The cell of a row, its inverse and the grid of cells at least ``radius`` wide.

    Numbers for a constant cell; else columns of ``table``, computed once per step and joined to frames.
    """

    rows: list
    inverse: list
    counts: list
    right_angled: bool
    table: DataFrame | None

    @property
    def held(self) -> list[str]:
        return [] if self.table is None else [c for c in self.table.columns if c not in ("traj_id", "step")]


def lattice(traj: Trajectory, radius: float) -> Lattice:
    def widths(cell: Sequence[G.Vector]) -> list:
        return [G.det(cell) / G.norm(G.cross(cell[(i + 1) % 3], cell[(i + 2) % 3])) / radius for i in range(3)]

    if traj.cell is not None:
        cell = G.constant_cell(traj.cell)
        counts = [int(n) if n >= 3 else 1 for n in map(abs, widths(cell))]
        return Lattice(cell, G.inverse(cell), counts, traj.right_angled, None)
    cell = traj.cell_columns()
    if traj.right_angled:
        cell = [[cell[i][j] if i == j else 0.0 for j in range(3)] for i in range(3)]
    inverse = G.inverse(cell)
    made = {f"i{i}{j}": G.column(inverse[i][j]) for i in range(3) for j in range(3) if isinstance(inverse[i][j], Column)}
    made |= {f"n{i}": F.when(F.abs(n) >= 3, F.floor(F.abs(n))).otherwise(1).cast("int") for i, n in enumerate(widths(cell))}
    kept = [n for i in range(3) for j, n in enumerate(G.CELL[3 * i : 3 * i + 3]) if isinstance(cell[i][j], Column)]
    table = traj.cells.select("traj_id", "step", *kept, *[c.alias(n) for n, c in made.items()])
    columns = [[F.col(f"i{i}{j}") if f"i{i}{j}" in made else inverse[i][j] for j in range(3)] for i in range(3)]
    return Lattice(cell, columns, [F.col(f"n{i}") for i in range(3)], traj.right_angled, table)


def _in_grid(rows: DataFrame, cell: Lattice, wide: bool) -> DataFrame:
    """Adds the grid cell c0, c1, c2; ``wide`` gives a row for each adjacent cell as well."""
    fractions = G.times(G.vector(*G.AXES), cell.inverse)
    rows = rows.withColumns({f"c{i}": F.lit(0) if isinstance(n, int) and n == 1 else F.least(F.floor(G.wrap(f) * n).cast("int"), G.column(n).cast("int") - 1) for i, (f, n) in enumerate(zip(fractions, cell.counts))})
    for i, n in enumerate(cell.counts):
        if wide and not (isinstance(n, int) and n == 1):
            c, n = F.col(f"c{i}"), G.column(n).cast("int")
            rows = rows.withColumn(f"c{i}", F.explode(F.when(n == 1, F.array(F.lit(0))).otherwise(F.array((c - 1 + n) % n, c, (c + 1) % n))))
    return rows


def pair_table(traj: Trajectory, frames: DataFrame, first: Column, second: Column, radius: float, image: str = "corners", ordered: bool = True, carry: Sequence[Column] = ()) -> DataFrame:
    """(traj_id, step, i, j, r, dx, dy, dz) of atoms i that pass ``first`` and j that pass ``second``, i <> j, r <= radius.

    ``first`` and ``second`` are conditions on type and atom_idx; without ``ordered`` pairs have i < j only.
    ``carry`` are named expressions of type and atom_idx that come along as i_name and j_name. ``image`` is
    ``corners`` (nearest of the cell's eight corners; no dx, dy, dz), ``minimum`` (each fraction within half
    a cell; right for axes at right angles) or ``mirrored`` (a fraction f over 1/2 becomes 1 - f, so its
    sign is lost).
    """
    cell = lattice(traj, radius)
    atoms = traj.atoms.select("traj_id", "atom_idx", first.alias("__first"), second.alias("__second"), *carry).where("__first or __second")
    names = [c for c in atoms.columns if c not in ("traj_id", "atom_idx", "__first", "__second")]
    typed = frames.select("traj_id", "step", "atom_idx", *G.AXES).join(small(atoms, traj.nat), ["traj_id", "atom_idx"])
    if cell.table is not None:
        typed = typed.join(cell.table, ["traj_id", "step"])
    left = _in_grid(typed.where("__first"), cell, wide=True).select("traj_id", "step", "c0", "c1", "c2", F.col("atom_idx").alias("i"), *G.AXES, *cell.held, *[F.col(c).alias(f"i_{c}") for c in names])
    right = _in_grid(typed.where("__second"), cell, wide=False).select("traj_id", "step", "c0", "c1", "c2", F.col("atom_idx").alias("j"), *[F.col(a).alias(f"q{a}") for a in G.AXES], *[F.col(c).alias(f"j_{c}") for c in names])
    met = left.join(right, ["traj_id", "step", "c0", "c1", "c2"]).where("i <> j" if ordered else "i < j")
    fractions = G.times([F.col(f"q{a}") - F.col(a) for a in G.AXES], cell.inverse)
    met = met.withColumns({f"f{k}": f for k, f in enumerate(fractions)})
    f = [F.col(f"f{k}") for k in range(3)]
    ids = ["traj_id", "step", "i", "j", *[f"{side}_{c}" for side in "ij" for c in names]]
    if image == "corners":
        met = met.withColumns({f"f{k}": G.wrap(x) for k, x in enumerate(f)})
        return met.select(*ids, G.nearest_corner(f, cell.rows, cell.right_angled).alias("r")).where(F.col("r") <= radius)
    if image == "minimum":
        moved = [x - G.nearest(x) for x in f]
    else:
        t = [G.truncated(x) for x in f]
        moved = [F.when(x < -0.5, x + 1).when(x > 0.5, 1 - x).otherwise(x) for x in t]
    met = met.withColumns({f"f{k}": x for k, x in enumerate(moved)})
    pairs = met.select(*ids, *[G.column(c).alias(f"d{a}") for c, a in zip(G.times(f, cell.rows), G.AXES)])
    return pairs.withColumn("r", G.norm(G.vector("dx", "dy", "dz"))).where(F.col("r") <= radius)


def _sizes(traj: Trajectory, spec: Spec) -> int:
    n = traj.atoms.where(_chosen(spec)).groupBy("traj_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if not n:
        raise InputError(f"no atom of {spec!r}")
    return n


def _last_volume(traj: Trajectory, istart: int, istop: int | None, stepsize: int) -> float:
    """Signed volume of the last frame used: what densities are relative to."""
    if traj.cell is not None:
        return G.det(G.constant_cell(traj.cell))
    cell = traj.cell_columns()
    used = (F.col("step") >= istart) & ((F.col("step") - istart) % stepsize == 0)
    cells = traj.cells.where(used if istop is None else used & (F.col("step") < istop))
    return cells.agg(F.max_by(G.det(cell), "step")).first()[0]


@dataclass(frozen=True)
class _Label:
    name: str
    one: Spec
    other: Spec
    n1: int
    n2: int
    both: int
    same: bool


def _labels(traj: Trajectory, species_pairs: Sequence[tuple[Spec, Spec]] | None) -> list[_Label]:
    """The pairs to count, with the sizes of their specs from one pass over the atoms; those of a single atom with itself are skipped."""
    pairs = default_pairs(traj.species()) if species_pairs is None else list(species_pairs)
    if not pairs:
        return []
    sums = []
    for k, (one, other) in enumerate(pairs):
        a, b = _chosen(one), _chosen(other)
        sums += [F.count_if(c).alias(f"{n}{k}") for n, c in (("a", a), ("b", b), ("both", a & b), ("odd", a != b))]
    of = traj.atoms.groupBy("traj_id").agg(*sums)
    row = of.agg(*[F.max(c).alias(c) for c in of.columns if c != "traj_id"]).first()
    out = []
    for k, (one, other) in enumerate(pairs):
        if not row[f"a{k}"] or not row[f"b{k}"]:
            raise InputError(f"no atom of {one!r} or {other!r}")
        label = _Label(f"{spec_label(one, k)}_{spec_label(other, k)}", one, other, row[f"a{k}"], row[f"b{k}"], row[f"both{k}"], not row[f"odd{k}"])
        if not (label.same and label.n1 == 1):
            out.append(label)
    return out


def labelled_pairs(traj: Trajectory, frames: DataFrame, labels: Sequence[_Label], radius: float) -> DataFrame:
    """(label number, r): every pair of every label, from one join for all of them.

    Atoms carry the bits of the specs they belong to, and an unordered pair counts for a label as often as
    one of its atoms is in the first spec while the other is in the second (once if both are one set).
    """
    if len(labels) > 30:
        parts = [labelled_pairs(traj, frames, labels[k : k + 30], radius).withColumn("label", F.col("label") + k) for k in range(0, len(labels), 30)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
    bits = F.lit(0).cast("long")
    for k, x in enumerate(labels):
        bits = bits + F.when(_chosen(x.one), F.lit(1 << 2 * k)).otherwise(F.lit(0)) + F.when(_chosen(x.other), F.lit(2 << 2 * k)).otherwise(F.lit(0))
    pairs = pair_table(traj, frames, bits != 0, bits != 0, radius, ordered=False, carry=[bits.alias("bits")])

    def has(side: str, k: int, which: int) -> Column:
        return F.getbit(F.col(f"{side}_bits"), F.lit(2 * k + which)) == 1

    counted = []
    for k, x in enumerate(labels):
        counted.append(F.when(has("i", k, 0) & has("j", k, 1), F.lit(k)))
        if not x.same:
            counted.append(F.when(has("j", k, 0) & has("i", k, 1), F.lit(k)))
    return pairs.select("r", F.explode(F.array_compact(F.array(*counted))).alias("label"))


def rdf_counts(traj: Trajectory, radius: float, species_pairs: Sequence[tuple[Spec, Spec]] | None = None, istart: int = 0, istop: int | None = None, stepsize: int = 1, nbins: int = 100) -> DataFrame:
    """(label, bin, n) of the bins that have pairs, counted in one pass."""
    labels = _labels(traj, species_pairs)
    frames, _ = frames_between(traj, istart, istop, stepsize)
    found = labelled_pairs(traj, frames, labels, radius).groupBy("label", G.histogram_bin(F.col("r"), radius / nbins, nbins).alias("bin")).agg(F.count("*").alias("n"))
    return found.withColumn("label", F.element_at(F.array(*[F.lit(x.name) for x in labels]), F.col("label") + 1))


def rdf(traj: Trajectory, radius: float, species_pairs: Sequence[tuple[Spec, Spec]] | None = None, istart: int = 0, istop: int | None = None, stepsize: int = 1, nbins: int = 100) -> DataFrame:
    """(label, bin, radius, rdf, integral), every bin of every pair.

    Counts are per frame and atom of the first spec (self pairs count twice), divided by the shell
    4 pi r^2 w at the bin's centre and the density of the second spec; ``integral`` is the running count.
    Self pairs of a single atom are skipped.
    """
    spark, labels, width = traj.spark, _labels(traj, species_pairs), radius / nbins
    if not labels:
        return inline(spark, [], "label string, bin int, radius double, rdf double, integral double")
    frames, counts = frames_between(traj, istart, istop, stepsize)
    volume, n_frames = _last_volume(traj, istart, istop, stepsize), max(sum(counts.values()), 1)
    found = labelled_pairs(traj, frames, labels, radius).groupBy("label", G.histogram_bin(F.col("r"), width, nbins).alias("bin")).agg(F.count("*").alias("n"))
    facts = inline(spark, [(k, x.name, (2.0 if x.same else 1.0) / (n_frames * x.n1), x.n2 / volume) for k, x in enumerate(labels)], "label int, name string, per double, density double")
    every = spark.range(len(labels) * nbins).select(F.floor(F.col("id") / nbins).cast("int").alias("label"), (F.col("id") % nbins).cast("int").alias("bin"))
    rows = every.join(F.broadcast(facts), "label").join(found, ["label", "bin"], "left").withColumn("hist", F.coalesce("n", F.lit(0)) * F.col("per"))
    centre = (F.col("bin") + 0.5) * width
    running = Window.partitionBy("label").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(F.col("name").alias("label"), "bin", centre.alias("radius"), (F.col("hist") / (F.lit(4 * math.pi * width) * centre * centre * F.col("density"))).alias("rdf"), F.sum("hist").over(running).alias("integral"))


def rdf_summary(traj: Trajectory, radius: float, species_pairs: Sequence[tuple[Spec, Spec]] | None = None, istart: int = 0, istop: int | None = None, stepsize: int = 1) -> DataFrame:
    """(label, shortest, n_pairs, n_data): shortest distance over all pairs, pairs a frame, frames by floor division.

    If no pair is within ``radius`` it is doubled until one is: the shortest distance of all pairs is then
    that of the pairs found.
    """
    labels = _labels(traj, species_pairs)
    frames, _ = frames_between(traj, istart, istop, stepsize)
    n_data = sum(((n if istop is None else istop) - istart) // stepsize for n in traj.nsteps.values())
    n_pairs = {k: x.n1 * (x.n1 - 1) // 2 if x.same else x.n1 * x.n2 - x.both for k, x in enumerate(labels)}
    shortest: dict[int, float] = {}
    reach = radius
    while n_data and reach < 1e6 * radius and (left := [k for k in n_pairs if n_pairs[k] and k not in shortest]):
        found = labelled_pairs(traj, frames, [labels[k] for k in left], reach).groupBy("label").agg(F.min("r").alias("r"))
        shortest |= {left[r.label]: r.r for r in found.collect()}  # a row for each label
        reach *= 2
    rows = [(x.name, shortest.get(k), n_pairs[k], n_data) for k, x in enumerate(labels)]
    return inline(traj.spark, rows, "label string, shortest double, n_pairs long, n_data long")


def rdf_nearest_bin(traj: Trajectory, radius: float, one: Spec, other: Spec, istart: int = 1, istop: int | None = None, stepsize: int = 1, nbins: int = 100) -> DataFrame:
    """(bin, radius, rdf, integral) by rounding distances to bins 1..nbins; frames are counted from 1 and ``istop`` is the last.

    A bin's shell is 4 pi/3 (3 r^2 w + 3/4 w^3), the first's the sphere of radius 3/2 w less that of w/2;
    its label is bin * w. The integral is 0 for the first bin and sums the counts of the later ones.
    """
    spark, width = traj.spark, radius / nbins
    stop = max(traj.nsteps.values()) if istop is None else istop
    frames = traj.slice_steps(istart - 1, stop, stepsize)
    n1, n2 = _sizes(traj, one), _sizes(traj, other)
    pairs = pair_table(traj, frames, _chosen(one), _chosen(other), radius + width, image="mirrored")
    found = pairs.groupBy(G.nearest(F.col("r") / F.lit(width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    weight = stepsize / (stop + 1 - istart) / n1
    bins = spark.range(1, nbins + 1).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left")
    r = F.col("bin") * F.lit(width)
    shell = F.lit(4 * math.pi / 3) * F.when(F.col("bin") == 1, F.lit(3.25 * width**3)).otherwise(3 * r * r * width + 0.75 * width**3)
    count = F.coalesce("n", F.lit(0)) * F.lit(weight)
    running = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # nbins rows
    integral = F.sum(F.when(F.col("bin") > 1, count).otherwise(0.0)).over(running)
    density = n2 / abs(_last_volume(traj, istart - 1, stop, stepsize))
    return bins.select("bin", r.alias("radius"), (count / shell / F.lit(density)).alias("rdf"), integral.alias("integral"))


def default_triples(species: Sequence[str]) -> list[tuple[str, str, str]]:
    return list(combinations_with_replacement(sorted(species), 3))


def angular_spectrum(traj: Trajectory, radius: float, species_triples: Sequence[tuple[Spec, Spec, Spec]] | None = None, istart: int = 1, istop: int | None = None, stepsize: int = 1, nbins: int = 100, fixed: bool = False) -> DataFrame:
    """(label, bin, angle, value), bins 1..nbins: angles at an atom of the first spec between neighbours within ``radius``.

    Each ordered pair of neighbours adds 1/(r2^2 r3^2), averaged over frames (counted from 1, ``istop`` the
    last) and atoms. The cell is constant. By default fractions over 1/2 are mirrored, which keeps
    lengths but not directions; ``fixed`` takes the nearest image instead. Cells with other than right
    angles need ``fixed``.
    """
    if traj.cell is None:
        raise InputError("angles need a constant cell")
    if not fixed and not traj.right_angled:
        raise InputError("cells without right angles need fixed=True")
    stop = max(traj.nsteps.values()) if istop is None else istop
    frames = traj.slice_steps(istart - 1, stop, stepsize)
    triples = default_triples(traj.species()) if species_triples is None else list(species_triples)
    parts = [_angles(traj, frames, triples[at : at + TRIPLES], at, radius, stepsize / (stop + 1 - istart), nbins, fixed) for at in range(0, len(triples), TRIPLES)]
    return reduce(DataFrame.unionByName, parts)


#: Triples of one pass over the neighbours: three bits of a long each.
TRIPLES = 20


def _angles(traj: Trajectory, frames: DataFrame, triples: list, first: int, radius: float, per_frame: float, nbins: int, fixed: bool) -> DataFrame:
    """The spectra of up to TRIPLES triples, the first of which is number ``first``."""
    spark = traj.spark
    sizes = [_sizes(traj, t[0]) for t in triples]
    bits = F.lit(0).cast("long")
    for k, triple in enumerate(triples):
        for j, spec in enumerate(triple):
            bits = bits + F.when(_chosen(spec), F.lit(1 << 3 * k + j)).otherwise(F.lit(0))
    pairs = pair_table(traj, frames, bits != 0, bits != 0, radius, "minimum" if fixed else "mirrored", carry=[bits.alias("bits")])
    one = pairs.select("traj_id", "step", "i", "j", "i_bits", "j_bits", "dx", "dy", "dz")
    other = pairs.select("traj_id", "step", "i", F.col("j").alias("k"), F.col("j_bits").alias("k_bits"), *[F.col(f"d{a}").alias(f"e{a}") for a in G.AXES])
    met = one.join(other, ["traj_id", "step", "i"]).where("j <> k")

    def has(side: str, k: int, which: int) -> Column:
        return F.getbit(F.col(f"{side}_bits"), F.lit(3 * k + which)) == 1

    labels = F.array_compact(F.array(*[F.when(has("i", k, 0) & has("j", k, 1) & has("k", k, 2), F.lit(k)) for k in range(len(triples))]))
    d, e = G.vector("dx", "dy", "dz"), G.vector("ex", "ey", "ez")
    bins = met.select(G.nearest(G.angle(d, e) / F.lit(180.0 / nbins)).cast("int").alias("bin"), (1 / (G.norm2(d) * G.norm2(e))).alias("w"), F.explode(labels).alias("label"))
    found = bins.groupBy("label", "bin").agg(F.sum("w").alias("s"))
    names = ["_".join(spec_label(s, n) for s in triple) for n, triple in enumerate(triples, first)]
    facts = inline(spark, [(k, name, per_frame / n1) for k, (name, n1) in enumerate(zip(names, sizes))], "label int, name string, per double")
    every = spark.range(len(triples) * nbins).select(F.floor(F.col("id") / nbins).cast("int").alias("label"), (F.col("id") % nbins + 1).cast("int").alias("bin"))
    rows = every.join(F.broadcast(facts), "label").join(found, ["label", "bin"], "left")
    return rows.select(F.col("name").alias("label"), "bin", (F.col("bin") * F.lit(180.0 / nbins)).alias("angle"), (F.coalesce("s", F.lit(0.0)) * F.col("per")).alias("value"))


def run_native_kernel(*_: object, **__: Mapping) -> None:
    """The compiled pair kernel was never offered through this interface; ``rdf_nearest_bin`` computes its result."""
    raise NotImplementedError("use rdf_nearest_bin")
