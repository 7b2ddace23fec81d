import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import array_of, trajectory

from driftframe.functions import geometry as G
from driftframe.functions.constants import ELEMENTS, colour
from driftframe.model import IncompatibleTrajectories, Trajectory, check_compatible, combined, from_atoms
from driftframe.operators.recenter import centre, recenter, velocities_from_positions

RNG = np.random.default_rng(42)
TYPES = ["H", "H", "H", "O", "O"]
POS, VEL = RNG.random((20, 5, 3)), RNG.random((20, 5, 3))


@pytest.fixture(scope="module")
def traj(spark):
    return trajectory(spark, POS, TYPES, VEL, cell=((2.0, 0, 0), (0, 3.0, 0), (0, 0, 4.0)), timestep=2.0)


def test_arrays(traj):
    assert traj.array_names() == ["positions", "velocities"] and "velocities" in traj and "forces" not in traj
    assert traj.nsteps == {0: 20} and traj.nat == 5 and traj.species() == ["H", "O"] and traj.timestep == 2.0
    assert np.allclose(array_of(traj.get_array("velocities"), ["vx", "vy", "vz"], 20, 5), VEL)
    assert np.allclose(array_of(traj.rescale_array("positions", 0.5).frames, ["x", "y", "z"], 20, 5), POS / 2)
    assert traj.remove_array("velocities").array_names() == ["positions"]
    with pytest.raises(KeyError):
        traj.remove_array("forces")
    with pytest.raises(KeyError):
        traj.get_array("nothing")
    f = traj.get_array("velocities").toDF("traj_id", "step", "atom_idx", "fx", "fy", "fz")
    assert traj.set_array("forces", f).array_names() == ["forces", "positions", "velocities"]
    with pytest.raises(ValueError):
        traj.set_array("velocities", f, check_existing=True)
    with pytest.raises(ValueError):
        traj.set_array("forces", f.drop("fz"))
    with pytest.raises(Exception, match="a key has no value"):
        traj.set_array("forces", f.where("step > 3")).frames.agg(F.sum("fx")).collect()


def test_step_arrays_and_attributes(spark, traj):
    steps = spark.range(20).select(F.lit(0).alias("traj_id"), F.col("id").alias("step"), (F.col("id") * 1.5).alias("potential_energy"))
    t = traj.set_array("potential_energy", steps).set_attr("a", [1, {"b": 2}])
    assert "potential_energy" in t and t.get_attr("a") == [1, {"b": 2}] and t.attrs_table().count() == 1
    assert t.snapshot(3).select("potential_energy").distinct().collect()[0][0] == 4.5
    assert "fx" not in t.snapshot(3, with_calculated=False).columns
    with pytest.raises(TypeError):
        traj.set_attr("a", {1, 2})
    with pytest.raises(ValueError):
        traj.set_array("stress", traj.frames.select("traj_id", "step", "atom_idx", F.lit(1.0).alias("sxx")))


def test_selectors(traj):
    assert [r.atom_idx for r in traj.indices_of_species("O", start=1).orderBy("atom_idx").collect()] == [4, 5]
    assert [r.atom_idx for r in traj.indices_of_species(2).collect()] == [2]
    with pytest.raises(TypeError):
        traj.indices_of_species(["O"])
    assert sorted({r.step for r in traj.slice_steps(2, 11, 4).collect()}) == [2, 6, 10]


def test_volumes(spark, traj):
    assert {r.volume for r in traj.volumes().collect()} == {24.0} and traj.volumes().count() == 20
    cells = RNG.normal(size=(4, 3, 3))
    t = trajectory(spark, POS[:4], TYPES, cells=cells)
    assert np.allclose([r.volume for r in t.volumes().orderBy("step").collect()], np.linalg.det(cells)) and not t.right_angled
    rows = t.cells.select("step", *[G.column(c).alias(f"i{i}{j}") for i, row in enumerate(G.inverse(G.cell_of())) for j, c in enumerate(row)]).orderBy("step").collect()
    assert np.allclose([np.array(r[1:]).reshape(3, 3) for r in rows], np.linalg.inv(cells))
    assert np.allclose(G.inverse(G.constant_cell(cells[0])), np.linalg.inv(cells[0]))


@pytest.mark.parametrize("options, weights", [
    ({}, [1.008] * 3 + [15.999] * 2), ({"mode": "geometric"}, [1] * 5), ({"sublattice": ["O"]}, [0] * 3 + [1] * 2), ({"sublattice": ["O", 0], "mode": "geometric"}, [1, 0, 0, 1, 1]),
])
def test_recenter(traj, options, weights):
    t = recenter(traj, **options)
    r, v = array_of(t.frames, ["x", "y", "z"], 20, 5), array_of(t.frames, ["vx", "vy", "vz"], 20, 5)
    for got, old in ((r, POS), (v, VEL)):
        assert np.abs(np.einsum("a,sac->sc", np.array(weights, float), got)).max() < 1e-12
        shift = old - got
        assert np.allclose(shift, shift[:, :1])  # every atom moves alike


def test_recenter_refuses(traj):
    with pytest.raises(TypeError):
        recenter(traj, sublattice="O")
    with pytest.raises(TypeError):
        recenter(traj, sublattice=[1.5])
    with pytest.raises(IndexError):
        recenter(traj, sublattice=[77])
    with pytest.raises(ValueError):
        recenter(traj, mode="other")
    assert centre(traj, "positions").count() == 20


def test_velocities(traj):
    with pytest.raises(ValueError):
        velocities_from_positions(traj)
    v = array_of(velocities_from_positions(traj, overwrite=True).frames, ["vx", "vy", "vz"], 20, 5)
    want = np.empty_like(POS)
    want[1:-1], want[0], want[-1] = (POS[2:] - POS[:-2]) / 4, (POS[1] - POS[0]) / 2, (POS[-1] - POS[-2]) / 2
    assert np.allclose(v, want)


def test_from_atoms_orders_by_number_and_drops_empty_arrays(spark):
    frames = [{"symbols": ["O", "H", "O", "H"], "positions": RNG.random((4, 3)), "velocities": np.zeros((4, 3)), "forces": RNG.random((4, 3)), "cell": np.eye(3) * (2 + k)} for k in range(3)]
    t = from_atoms(spark, frames, 1.5, {"charge": RNG.random((3, 4)), "energy": [1.0, 2.0, 3.0]})
    assert [r.type for r in t.atoms.orderBy("atom_idx").collect()] == ["H", "H", "O", "O"]
    assert t.array_names() == ["cells", "charge", "energy", "forces", "positions"]
    assert np.allclose(array_of(t.frames, ["x", "y", "z"], 3, 4)[1], frames[1]["positions"][[1, 3, 0, 2]])
    with pytest.raises(IncompatibleTrajectories):
        from_atoms(spark, [frames[0], {**frames[1], "symbols": ["O", "H", "H", "H"]}], 1.0)


def test_compatibility(spark, traj):
    same = trajectory(spark, POS, TYPES, VEL, traj.cell, 2.0)
    assert combined([traj, same]).nsteps == {0: 20, 1: 20}
    for other in (trajectory(spark, POS, TYPES, VEL, None, 3.0), trajectory(spark, POS, TYPES, None, None, 2.0), trajectory(spark, POS, ["O", *TYPES[1:]], VEL, None, 2.0), trajectory(spark, POS[:, :4], TYPES[:4], VEL[:, :4], None, 2.0)):
        with pytest.raises(IncompatibleTrajectories):
            check_compatible([traj, other])
    with pytest.raises(TypeError):
        check_compatible([traj, "x"])
    assert isinstance(combined([traj]), Trajectory)


def test_elements():
    assert len(ELEMENTS) == 118 and ELEMENTS[25] == ("Fe", 26, 55.845) and ELEMENTS[117][0] == "Og"
    assert colour("H") == (0, 0, 0) and colour("Xx") is None
    with pytest.raises(ValueError):
        colour("H", "none")
