import numpy as np
from helpers import trajectory
from pyspark.sql import functions as F

from driftframe import cli
from driftframe.operators.kinetic import kinetic_of_system
from driftframe.operators.recenter import centre
from driftframe.sources import store, xsf
from driftframe.streaming.frames import arriving, temperatures

RNG = np.random.default_rng(8)
CELL = ((3.0, 0, 0), (0, 3.0, 0), (0, 0, 3.0))


def test_commands(spark, tmp_path, capsys):
    pos = RNG.uniform(0, 3, size=(30, 4, 3))
    traj = trajectory(spark, pos, ["H", "H", "O", "O"], pos, cell=CELL, timestep=2.0)
    at = lambda name: f"file://{tmp_path}/{name}"
    store.save(traj, at("t"))
    assert cli.main(["msd", at("t"), "--t-end-fit-fs", "10", "--nblocks", "2", "--recenter", "--out", at("msd")], spark) == 0
    assert spark.read.parquet(at("msd/diffusion")).count() == 2 and "nr_of_t" in capsys.readouterr().out
    assert cli.main(["rdf", at("t"), "--radius", "1.2", "--nbins", "5", "--species", "H", "--out", at("rdf")], spark) == 0
    assert {r.label for r in spark.read.parquet(at("rdf/rdf")).collect()} == {"H_H", "H_O"}
    assert cli.main(["density", at("t"), "--element", "H", "--sigma", "0.3", "--n-sigma", "1", "--spacing", "1.0", "--xsf", at("d.xsf")], spark) == 0
    back = xsf.read_xsf(spark, at("d.xsf"))
    assert back.shape == (4, 4, 4) and np.isclose(back.grid.agg(F.sum("value")).first()[0] * 27 / 64, 2.0) and back.atoms.count() == 2
    assert cli.main(["xsf", at("d.xsf")], spark) == 0 and "least" in capsys.readouterr().out
    (tmp_path / "d").write_text("ITEM: TIMESTEP\n0\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 1\n0 1\n0 1\nITEM: ATOMS id type x y z\n1 1 0.5 0.5 0.5\n")
    assert cli.main(["convert", at("d"), "--elements", "Li", "--extxyz", at("d.xyz"), "--out", at("c")], spark) == 0
    assert store.load(spark, at("c")).species() == ["Li"] and cli.main(["convert", at("d.xyz"), "--out", at("e")], spark) == 0


def test_stream(spark, tmp_path):
    pos, vel = RNG.normal(size=(40, 3, 3)), RNG.normal(size=(40, 3, 3))
    traj = trajectory(spark, pos, ["H", "H", "O"], vel, timestep=2.0)
    order = ["traj_id", "step", "atom_idx", "x", "y", "z", "vx", "vy", "vz"]
    for a in range(0, 40, 10):
        rows = traj.frames.where((F.col("step") >= a) & (F.col("step") < a + 10)).withColumns({"step": F.col("step").cast("long"), "traj_id": F.col("traj_id").cast("int"), "atom_idx": F.col("atom_idx").cast("int")})
        rows.select(*order).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = temperatures(arriving(spark, f"file://{tmp_path}/in", 2.0, files_per_trigger=1), traj.atoms, 4)
    query = stream.writeStream.format("memory").queryName("temperatures").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.step: r for r in spark.table("temperatures").collect()}
    want = {r.step: r.kinetic for r in kinetic_of_system(traj).collect()}
    com = {r.step: r for r in centre(traj, "positions").collect()}
    assert set(range(30)) <= set(got)  # the last steps are open still
    for s, r in got.items():
        assert np.isclose(r.kinetic, want[s]) and np.isclose(r.com_y, com[s].y)
