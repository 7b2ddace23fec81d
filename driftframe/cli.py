"""Command line: python -m driftframe.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.analyzer import RDF, DynamicsAnalyzer
from driftframe.operators import density, grid
from driftframe.operators.recenter import recenter
from driftframe.sources import extxyz, lammps, store, xsf


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftframe")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("--out", help="folder of Parquet tables; default: print")
        return c

    c = command("msd", "displacements and diffusion of a stored trajectory")
    c.add_argument("--timestep", type=float, help="fs; default: the stored one")
    c.add_argument("--nblocks", type=int, default=1)
    c.add_argument("--t-start-fit-fs", type=float, default=0.0)
    c.add_argument("--t-end-fit-fs", type=float, required=True)
    c.add_argument("--stepsize", type=int, default=1)
    c.add_argument("--species", nargs="*")
    c.add_argument("--decomposed", action="store_true")
    c.add_argument("--recenter", action="store_true")
    c = command("rdf", "radial distributions of a stored trajectory")
    c.add_argument("--radius", type=float, required=True)
    c.add_argument("--nbins", type=int, default=100)
    c.add_argument("--species", nargs="*", help="pairs of each of these with every species")
    c.add_argument("--stepsize", type=int, default=1)
    c = command("convert", "a dump or extxyz file to a stored trajectory (--out) or extxyz (--extxyz)")
    c.add_argument("--elements", nargs="*")
    c.add_argument("--timestep", type=float, default=1.0)
    c.add_argument("--thermo")
    c.add_argument("--thermo-pe")
    c.add_argument("--skip", type=int, default=0)
    c.add_argument("--istep", type=int, default=1)
    c.add_argument("--extxyz")
    command("xsf", "least, most, total, mean and deviation of an XSF grid")
    c = command("density", "density of a species of a stored trajectory, as XSF")
    c.add_argument("--element", required=True)
    c.add_argument("--sigma", type=float, default=0.3)
    c.add_argument("--n-sigma", type=float, default=3.0)
    c.add_argument("--spacing", type=float, default=0.1, help="Angstrom")
    c.add_argument("--xsf", required=True)
    return p


def _give(tables: dict[str, DataFrame], out: str | None) -> None:
    for name, table in tables.items():
        if out:
            table.write.mode("overwrite").parquet(f"{out}/{name}")
        else:
            print(f"# {name}")
            table.show(200, truncate=False)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("driftframe").getOrCreate()
    if args.command == "convert":
        if args.input.endswith("xyz"):
            traj = extxyz.read_extxyz(spark, args.input, args.timestep)
        else:
            traj = lammps.read_dump(spark, args.input, elements=args.elements, timestep=args.timestep, thermo_file=args.thermo, thermo_pe=args.thermo_pe, skip=args.skip, istep=args.istep)
        if args.out:
            store.save(traj, args.out)
        if args.extxyz:
            extxyz.write_extxyz(traj, args.extxyz)
        return 0
    if args.command == "xsf":
        _give({"summary": grid.summary(xsf.read_xsf(spark, args.input).grid)}, args.out)
        return 0
    traj = store.load(spark, args.input)
    if args.command == "msd":
        traj = recenter(traj) if args.recenter else traj
        traj = replace(traj, timestep_fs=args.timestep) if args.timestep else traj
        options = {"t_start_fit_fs": args.t_start_fit_fs, "t_end_fit_fs": args.t_end_fit_fs, "nr_of_blocks": args.nblocks, "stepsize_t": args.stepsize}
        result = DynamicsAnalyzer(traj, args.species or None).get_msd(decomposed=args.decomposed, **options)
        _give(dict(result.tables), args.out)
        print(json.dumps(result.attrs, default=str))
    elif args.command == "rdf":
        every = traj.species()
        pairs = None if not args.species else sorted({tuple(sorted((a, b))) for a in args.species for b in every})
        _give(dict(RDF(traj).run(args.radius, pairs, stepsize=args.stepsize, nbins=args.nbins).tables), args.out)
    else:
        spec = density.grid_spec(traj.cell, args.sigma, args.n_sigma, args.spacing)
        table = density.gaussian_density(traj, args.element, spec)
        rest = traj.snapshot(0).where(F.col("type") != args.element).orderBy("atom_idx").select("type", "x", "y", "z").collect()  # one step's atoms go in the file's header
        xsf.write_xsf(table, spec.shape, spec.cell, [tuple(r) for r in rest], args.xsf, fixed_point=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
