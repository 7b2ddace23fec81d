from dataclasses import replace

import numpy as np
import pytest
from helpers import array_of, trajectory
from pyspark.sql import functions as F

from driftframe.functions.constants import BOHR_IN_ANGSTROM
from driftframe.sources import extxyz, lammps, store, xsf

RNG = np.random.default_rng(5)


def dump(path, frames, columns, box="ITEM: BOX BOUNDS pp pp pp\n0.0 2.0\n0.0 4\n-1e0 7.0"):
    """frames: list of (timestep, rows)."""
    with open(path, "w") as f:
        for step, rows in frames:
            f.write(f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{len(rows)}\n{box}\nITEM: ATOMS {columns}\n" + "".join(" ".join(map(str, r)) + " \n" for r in rows))
    return f"file://{path}"


def test_dump(spark, tmp_path):
    pos = RNG.normal(size=(7, 3, 6))
    frames = [(100 + 10 * k, [(i + 1, 2 - i % 2, *pos[k, i]) for i in RNG.permutation(3)]) for k in range(7)]
    path = dump(tmp_path / "a", frames, "id type x y z fx fy fz")
    t = lammps.read_dump(spark, path, elements=["O", "H"], skip=1, istep=2, f_conv=0.5, timestep=4.0)
    assert [r.type for r in t.atoms.orderBy("atom_idx").collect()] == ["H", "O", "H"] and t.timestep == 4.0
    assert np.allclose(array_of(t.frames, ["x", "y", "z", "fx", "fy", "fz"], 3, 3), pos[[2, 4, 6]] * ([1] * 3 + [0.5] * 3))
    assert [r.raw_timestep for r in t.steps.orderBy("step").collect()] == [120, 140, 160]
    c = t.cells.first()
    assert (c.ax, c.by, c.cz) == (2.0, 4.0, 8.0) and t.volumes().first().volume == 64.0
    assert "forces" not in lammps.read_dump(spark, path, ignore_forces=True) and lammps.read_dump(spark, path).species() == ["H"]


def test_dump_styles(spark, tmp_path):
    rows = [(2, "O", 0.5, 0.5, 0.5, 7, 8, 9, 3.5), (1, "H", 0.25, 0.75, -0.5, 1, 2, 3, 4.5)]
    t = lammps.read_dump(spark, dump(tmp_path / "s", [(0, rows)], "id element xs ys zs x y z q"), additional_columns=["q"])
    assert np.allclose(array_of(t.frames, ["x", "y", "z", "q"], 1, 2)[0], [[0.5, 3.0, -4.0, 4.5], [1.0, 2.0, 4.0, 3.5]])
    assert [r.type for r in t.atoms.orderBy("atom_idx").collect()] == ["H", "O"]
    box = "ITEM: BOX BOUNDS xy xz yz pp pp pp\n0.0 3.0 1.0\n0.0 4.0 0.5\n0.0 5.0 -0.5"
    tilted = dump(tmp_path / "t", [(0, [(1, 1, 0.5, 0.5, 0.5)])], "id Type xs ys zs", box)
    c = lammps.read_dump(spark, tilted).cells.first()
    assert [c[n] for n in ("ax", "bx", "by", "cx", "cy", "cz")] == [3.0, 1.0, 4.0, 0.5, -0.5, 5.0]
    c = lammps.read_dump(spark, tilted, correct_tilt=True).cells.first()
    assert (c.ax, c.by, c.cz) == (1.5, 3.5, 5.0)
    u = lammps.read_dump(spark, dump(tmp_path / "u", [(0, [(1, 1, 9, 9, 9, 1, 2, 3)])], "id type x y z xu yu zu"))
    assert np.allclose(array_of(u.frames, ["x", "y", "z"], 1, 1), [[[1, 2, 3]]])
    near = lammps.read_dump(spark, dump(tmp_path / "m", [(0, [(1, 2, 1, 2, 3), (2, 1, 1, 2, 3)])], "id type x y z"), mass_types={1: 16.1, 2: 6.8})
    assert [r.type for r in near.atoms.orderBy("atom_idx").collect()] == ["Li", "O"]
    for columns in ("id type xsu ysu zsu", "id type a b c"):
        with pytest.raises((NotImplementedError, lammps.DumpError)):
            lammps.read_dump(spark, dump(tmp_path / "x", [(0, [(1, 1, 1, 2, 3)])], columns))


def test_dump_ends_where_atoms_change(spark, tmp_path):
    rows = [(1, 1, 0, 0, 0), (2, 1, 1, 1, 1)]
    t = lammps.read_dump(spark, dump(tmp_path / "n", [(0, rows), (1, rows), (2, rows[:1]), (3, rows)], "id type x y z"))
    assert t.nsteps == {0: 2}
    with pytest.raises(lammps.DumpError):
        lammps.read_dump(spark, dump(tmp_path / "n", [], "id"))


def test_dump_frames_that_lack_atoms(spark, tmp_path):
    a, b, c = (7, 1, 0, 0, 1), (2, 2, 0, 0, 2), (5, 3, 0, 0, 3)
    path = dump(tmp_path / "l", [(0, [c, b]), (1, [a, b, c]), (2, []), (3, [c]), (4, [a, b])], "id type x y z")
    with open(tmp_path / "l", "a") as f:  # a frame that the file cuts short
        f.write("ITEM: TIMESTEP\n5\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 2\n0 4\n-1 7\nITEM: ATOMS id type x y z\n7 1 0 0 1\n")
    t = lammps.read_dump(spark, path, elements=["H", "O", "Li"], partial=True)
    assert [(r.atom_idx, r.type) for r in t.atoms.orderBy("atom_idx").collect()] == [(0, "O"), (1, "Li"), (2, "H")]
    assert sorted((r.step, r.atom_idx, r.z) for r in t.frames.collect()) == [(0, 0, 2), (0, 1, 3), (1, 0, 2), (1, 1, 3), (1, 2, 1), (3, 1, 3), (4, 0, 2), (4, 2, 1)]
    assert [r.raw_timestep for r in t.steps.orderBy("step").collect()] == [0, 1, 2, 3, 4]


def test_frames_of_many_splits(spark, tmp_path):
    frames = [(k % 50, [(1, 1, k, 0, 0)]) for k in range(3000)]  # timesteps repeat: only the file's order tells
    path = dump(tmp_path / "big", frames, "id type x y z")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        t = lammps.read_dump(spark, path)
        assert t.frames.rdd.getNumPartitions() > 5
        assert [r.x for r in t.frames.orderBy("step").collect()] == list(map(float, range(3000)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_thermo(spark, tmp_path):
    path = dump(tmp_path / "d", [(0, [(1, 1, 0, 0, 0)]), (5, [(1, 1, 1, 0, 0)])], "id type x y z")
    log = tmp_path / "log"
    log.write_text("first\n# TimeStep pe pxx Temp\n0 1.5 2.0 300\n5 2.5 3.0 310\n0 9.9 9.9 9\n7 0 0 0\n")
    t = lammps.read_dump(spark, path, thermo_file=f"file://{log}", thermo_pe="pe", thermo_stress=["pxx"] * 6, thermo_keywords=["Temp"], e_conv=2.0, s_conv=10.0)
    assert [tuple(r) for r in t.steps.orderBy("step").select("potential_energy", "sxx", "syz", "Temp").collect()] == [(3.0, 20.0, 20.0, 300.0), (5.0, 30.0, 30.0, 310.0)]
    log.write_text("first\n# TimeStep pe\n0 1.5\n")
    with pytest.raises(Exception, match="no thermo row for timestep 5"):
        lammps.read_dump(spark, path, thermo_file=f"file://{log}", thermo_pe="pe").steps.collect()
    with pytest.raises(lammps.DumpError):
        lammps.read_dump(spark, path, thermo_file=f"file://{log}", thermo_keywords=["nothing"])


def test_xsf(spark, tmp_path):
    shape, cell = (3, 2, 4), ((3.0, 0, 0), (0.5, 2.0, 0), (0, 0, 4.0))
    values = RNG.normal(size=shape)
    g = spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(values) for i in [i]], "ix int, iy int, iz int, value double")
    path = f"file://{tmp_path}/a.xsf"
    xsf.write_xsf(g, shape, cell, [("Li", 3.5, -0.5, 9.0), ("O", 0, 0, 0)], path)
    text = (tmp_path / "a.xsf").read_text().split("\n")
    assert text[0] == " CRYSTAL" and text[5] == "PRIMCOORD" and text[12].split() == ["4", "3", "5"] and text[17].count("E") == 6
    back = xsf.read_xsf(spark, path, fold_positions=True)
    assert back.shape == shape and np.isclose(back.volume_ang, 24.0) and back.cell == cell
    got = np.zeros(shape)
    for r in back.grid.collect():
        got[r.ix, r.iy, r.iz] = r.value
    assert np.allclose(got, values, atol=1e-3) and back.grid.count() == 24
    a = back.atoms.orderBy("atom_idx").first()
    f = np.array([3.5, -0.5, 9.0]) @ np.linalg.inv(np.array(cell)) % 1.0 @ np.array(cell)
    assert a.type == "Li" and np.allclose([a.x, a.y, a.z], f)
    assert np.isclose(back.total_charge().first().charge, back.volume_au * values.mean(), rtol=1e-2)
    xsf.write_grid(g, shape, f"file://{tmp_path}/g")
    lines = (tmp_path / "g").read_text().split("\n")
    assert lines[0].split() == ["3", "4", "3", "5"] and [len(x.split()) for x in lines[1:5]] == [6] * 4
    xsf.write_xsf(g, shape, cell, [], f"file://{tmp_path}/flat", is_flattened=True)
    assert sum(x.count("E+") + x.count("E-") for x in (tmp_path / "flat").read_text().split("\n")) == 24
    (tmp_path / "none").write_text("PRIMVEC\n1 0 0\n0 1 0\n0 0 1\n")
    with pytest.raises(xsf.XsfError):
        xsf.read_xsf(spark, f"file://{tmp_path}/none")


def test_single_files_of_many_sorted_parts(spark, tmp_path):
    from driftframe.sources.text import write_single

    n = 20_000
    rows = spark.range(n, numPartitions=7).select(F.col("id"), F.when(F.col("id") % 100 == 7, "").otherwise(F.concat(F.lit("é "), F.col("id"))).alias("value")).orderBy(F.hash("id"))
    stages = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup("single", "")
    try:
        write_single(rows, f"file://{tmp_path}/one", ["id"])
        tasks = [stages.getStageInfo(i).numTasks for j in stages.getJobIdsForGroup("single") for i in stages.getJobInfo(j).stageIds]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (tmp_path / "one").read_text(encoding="utf-8") == "".join("\n" if k % 100 == 7 else f"é {k}\n" for k in range(n))
    assert tasks and min(tasks) > 1  # no task sorts all
    write_single(rows.where("id < 3"), f"file://{tmp_path}/one", ["id"])
    assert (tmp_path / "one").read_text(encoding="utf-8") == "é 0\né 1\né 2\n"
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")) == ["one"]
    write_single(rows.where("id < 0"), f"file://{tmp_path}/none", ["id"])
    assert (tmp_path / "none").read_text() == ""


def test_rdf_table(spark, tmp_path):
    rows = spark.createDataFrame([("a_b", k, k + 0.5, k * 2.0, 1.0) for k in (2, 0, 1)], "label string, bin int, radius double, rdf double, integral double")
    xsf.write_rdf_table(rows, f"file://{tmp_path}/r.dat")
    lines = (tmp_path / "r.dat").read_text().splitlines()
    assert lines[0].startswith("# radius") and [list(map(float, x.split())) for x in lines[1:]] == [[0.5, 0, 1], [1.5, 2, 1], [2.5, 4, 1]]


def test_words_and_numbers(spark):
    from driftframe.sources.text import number, words

    row = spark.createDataFrame([("  a\tb  1.5D+01 ", " ")], "x string, y string").select(words("x").alias("x"), words("y").alias("y"), number(F.get(words("x"), F.lit(2))).alias("n"), number(F.lit("no")).alias("bad")).first()
    assert (row.x, row.y, row.n, row.bad) == (["a", "b", "1.5D+01"], [], 15.0, None)


def test_extxyz_and_blocks(spark, tmp_path):
    pos, vel = RNG.normal(size=(4, 3, 3)), RNG.normal(size=(4, 3, 3))
    t = trajectory(spark, pos, ["O", "H", "O"], vel, cell=((1.0, 0, 0), (0, 2.0, 0), (0, 0, 3.0)))
    path = f"file://{tmp_path}/t.extxyz"
    extxyz.write_extxyz(t, path)
    back = extxyz.read_extxyz(spark, path, 2.0)
    assert [r.type for r in back.atoms.orderBy("atom_idx").collect()] == ["H", "O", "O"] and back.timestep == 2.0
    assert np.allclose(array_of(back.frames, ["x", "y", "z"], 4, 3), pos[:, [1, 0, 2]]) and np.allclose(array_of(back.frames, ["vx", "vy", "vz"], 4, 3), vel[:, [1, 0, 2]])
    assert {r.volume for r in back.volumes().collect()} == {6.0}
    (tmp_path / "p").write_text("".join(f"{10 * k} {0.001 * k}\n" + "".join(f"{k} {i} 1\n" for i in range(2)) for k in range(3)) + "30 0.003\n")
    table, dt = extxyz.read_cp_positions(spark, f"file://{tmp_path}/p", 2)
    assert np.isclose(dt, 1.0) and np.allclose(array_of(table, ["x", "y", "z"], 3, 2)[2], np.array([[2, 0, 1], [2, 1, 1]]) * BOHR_IN_ANGSTROM)
    (tmp_path / "in").write_text("&system\n nat = 2,\n/\nATOMIC_POSITIONS (bohr)\n#x\nO 1.0 2.0 3.0\nH 0.0 0.0 1.0d0\nK_POINTS\n")
    rows = extxyz.read_start_positions(spark, f"file://{tmp_path}/in").orderBy("atom_idx").collect()
    assert [r.type for r in rows] == ["O", "H"] and np.isclose(rows[0].z, 3 * BOHR_IN_ANGSTROM)
    assert extxyz.shifted(back, (1, 0, 0)).frames.agg(F.sum("x")).first()[0] == pytest.approx(pos[:, :, 0].sum() + 12)


def test_extxyz_frames_that_lack_atoms(spark, tmp_path):
    pos = RNG.normal(size=(40, 4, 3))
    t = trajectory(spark, pos, ["O", "H", "Li", "H"], cells=np.array([np.eye(3) * (k + 1.0) for k in range(40)]))
    short = replace(t, frames=t.frames.where("not (step = 0 and atom_idx = 1 or step = 7 and atom_idx < 3 or step = 39 and atom_idx in (0, 2))"))
    extxyz.write_extxyz(short, f"file://{tmp_path}/t.extxyz", partial=True)
    path = tmp_path / "cut.extxyz"
    path.write_text((tmp_path / "t.extxyz").read_text() + "2\nProperties=species:S:1:pos:R:3:id:I:1\nH 0 0 0 2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        back = extxyz.read_extxyz(spark, f"file://{path}", partial=True)
        order = [1, 3, 2, 0]
        want = {(s, order.index(a)): tuple(pos[s, a]) for s in range(40) for a in range(4) if not (s == 0 and a == 1 or s == 7 and a < 3 or s == 39 and a in (0, 2))}
        assert [r.type for r in back.atoms.orderBy("atom_idx").collect()] == ["H", "H", "Li", "O"]
        got = {(r.step, r.atom_idx): (r.x, r.y, r.z) for r in back.frames.collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
        assert sorted((r.step, r.ax) for r in back.cells.collect()) == [(k, k + 1.0) for k in range(40)]
        with open(path, "a") as f:
            f.write("H 0 0 0 4\n1\nLattice=\"1 0")
        more = extxyz.read_extxyz(spark, f"file://{path}", partial=True).frames
        assert more.count() == len(want) + 2 and more.where("step = 40 and atom_idx < 2").count() == 2
        with open(path, "a") as f:
            f.write("\nH 0 0 0 1\n")
        with pytest.raises(ValueError, match="don't name Properties"):
            extxyz.read_extxyz(spark, f"file://{path}", partial=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    extxyz.write_extxyz(t, f"file://{tmp_path}/t.extxyz")
    with pytest.raises(ValueError, match="column id"):
        extxyz.read_extxyz(spark, f"file://{tmp_path}/t.extxyz", partial=True)


def test_forces(spark, tmp_path):
    (tmp_path / "f1").write_text("text\n  Li 1.0 2.0 -3e-1\nO 1 1 1\nLi .5 0. +4\n")
    (tmp_path / "f2").write_text("Li 0.5 0.5 0.5 9\nLi 1 1 1 9\n")
    a, b = (extxyz.read_forces(spark, f"file://{tmp_path}/{n}", ["Li"]) for n in ("f1", "f2"))
    assert [r["values"] for r in a.orderBy("nth").collect()] == [[1.0, 2.0, -0.3], [0.5, 0.0, 4.0]]
    assert [r["values"] for r in extxyz.force_difference(a, b).orderBy("nth").collect()] == [[0.5, 1.5, -0.8, -9.0], [-0.5, -1.0, 3.0, -9.0]]
    with pytest.raises(Exception, match="fewer columns"):
        extxyz.force_difference(b, a).collect()


@pytest.mark.parametrize("by_type", [False, True])
def test_store(spark, tmp_path, by_type):
    pos, cells = RNG.normal(size=(4, 3, 3)), RNG.normal(size=(4, 3, 3))
    t = trajectory(spark, pos, ["O", "H", "O"], pos * 2, cells=cells, timestep=2.5).set_attr("k", [1, "a"])
    store.save(t, f"file://{tmp_path}/s", by_type)
    back = store.load(spark, f"file://{tmp_path}/s")
    assert back.timestep == 2.5 and back.get_attrs() == {"k": [1, "a"]} and back.array_names() == t.array_names() and back.nsteps == {0: 4}
    assert np.allclose(array_of(back.frames, ["x", "y", "z"], 4, 3), pos)
    plan = back.frames._jdf.queryExecution().toString()
    assert "parquet" in plan


def test_array_archive(spark, tmp_path):
    pos, cells = RNG.normal(size=(4, 3, 3)), RNG.normal(size=(4, 3, 3))
    t = trajectory(spark, pos, ["O", "H", "O"], pos * 2, cells=cells, timestep=2.5).set_attr("k", 3)
    steps = spark.createDataFrame([(0, s, float(s)) for s in range(4)], "traj_id int, step long, potential_energy double")
    t = t.set_array("potential_energy", steps).set_array("extra", t.frames.select("traj_id", "step", "atom_idx", (F.col("x") + 1).alias("extra")))
    store.save_arrays(t, str(tmp_path / "a.tar.gz"))
    back = store.load_arrays(spark, f"file://{tmp_path}/a.tar.gz")
    assert back.array_names() == ["cells", "extra", "positions", "potential_energy", "velocities"] and back.timestep == 2.5 and back.attrs["k"] == 3
    assert np.allclose(array_of(back.frames, ["x", "vy", "extra"], 4, 3), np.stack([pos[..., 0], 2 * pos[..., 1], pos[..., 0] + 1], axis=-1))
    assert [r.type for r in back.atoms.orderBy("atom_idx").collect()] == ["O", "H", "O"] and [r.potential_energy for r in back.steps.orderBy("step").collect()] == [0, 1, 2, 3]
    assert np.allclose([r.volume for r in back.volumes().orderBy("step").collect()], np.linalg.det(cells))
