import numpy as np
import pytest
from helpers import msd, trajectory, vaf

from driftframe.analyzer import DynamicsAnalyzer
from driftframe.functions.constants import KINETIC_FACTOR
from driftframe.model import combined
from driftframe.operators.msd import msd_blocks
from driftframe.operators.spectrum import power_spectrum
from driftframe.params import InputError
from driftframe.plans import plotdata

RNG = np.random.default_rng(3)
TYPES = ["H", "H", "H", "O", "O"]
H, O = [0, 1, 2], [3, 4]
POS, VEL = np.cumsum(RNG.normal(size=(60, 5, 3)), axis=0), RNG.normal(size=(60, 5, 3))


@pytest.fixture(scope="module")
def traj(spark):
    return trajectory(spark, POS, TYPES, VEL, timestep=2.0)


def blocks(df, value, species, nb, nt):
    out = np.full((nb, nt), np.nan)
    for r in df.where(f"species = '{species}'").select("block", "t_idx", value).collect():
        out[r[0], r[1]] = r[2]
    return out


@pytest.mark.parametrize("s, q, nb", [(1, 1, 2), (2, 3, 2), (3, 2, 1)])
def test_msd(traj, s, q, nb):
    res = DynamicsAnalyzer(traj).get_msd(t_end_fit_dt=12, stepsize_t=s, stepsize_tau=q, nr_of_blocks=nb)
    b, nt = (60 - 12) // nb, 12 // s
    want = msd(POS, H, nt, s, q, b, nb)
    assert np.allclose(blocks(res["msd"], "msd", "H", nb, nt), np.trace(want, axis1=2, axis2=3))
    row = res["msd"].where("t_idx = 2").first()
    assert row.t_fs == 2 * s * 2.0 and row.lag_dt == 3 * s
    x = 2.0 * s * np.arange(nt)
    for r in res["fits"].where("species = 'H'").collect():
        assert np.allclose(np.polyfit(x, np.trace(want[r.block], axis1=1, axis2=2), 1), (r.slope, r.intercept))
    slopes = [r.slope for r in res["fits"].where("species = 'H'").collect()]
    d = res["diffusion"].where("species = 'H'").first()
    assert np.isclose(d.diffusion_mean_cm2_s, np.mean(slopes) * 0.1 / 6)
    if nb > 1:
        assert np.isclose(d.slope_sem, np.std(slopes) / np.sqrt(nb - 1))
    else:
        assert np.isnan(d.slope_std) and np.isnan(d.slope_sem)


def test_decomposed_and_multiple_fits(traj):
    res = DynamicsAnalyzer(traj, "O").get_msd(decomposed=True, t_start_fit_dt=[0, 3], t_end_fit_dt=[6, 12], nr_of_blocks=2)
    want = msd(POS, O, 12, 1, 1, 24, 2)
    for r in res["msd"].collect():
        assert np.isclose(r.msd, want[r.block, r.t_idx, "xyz".index(r.i), "xyz".index(r.j)])
    assert res["fits"].count() == 2 * 2 * 9 and res["diffusion"].count() == 18
    d = res["diffusion"].where("fit_idx = 1 and i = 'x' and j = 'x'").first()
    assert np.isclose(d.diffusion_mean_cm2_s, d.slope_mean * 0.1 / 2)


def test_ballistic_motion(spark):
    v = np.array([0.5, -1.0, 2.0])
    r = np.arange(50)[:, None, None] * 2.0 * v[None, None, :] * np.ones((1, 4, 1))
    t = trajectory(spark, r, ["Al"] * 4, timestep=2.0)
    for row in DynamicsAnalyzer(t).get_msd(t_end_fit_dt=10)["msd"].collect():
        assert np.isclose(row.msd, (v @ v) * (row.lag_dt * 2.0) ** 2)


def test_com_atom_indices_and_long(traj):
    a = DynamicsAnalyzer(traj)
    mass = np.array([1.008] * 3 + [15.999] * 2)
    com = np.einsum("a,sac->sc", mass / mass.sum(), POS)[:, None, :]
    want = np.trace(msd(com, [0], 12, 1, 1, 24, 2), axis1=2, axis2=3)
    res = a.get_msd(t_end_fit_dt=12, nr_of_blocks=2, do_com=True)["msd"]
    assert np.allclose(blocks(res, "msd", "H", 2, 12), 3 * want) and np.allclose(blocks(res, "msd", "O", 2, 12), 2 * want)
    with pytest.raises(InputError):
        a.get_msd(t_end_fit_dt=12, do_com=True, atom_indices=[2])
    some = a.get_msd(t_end_fit_dt=12, nr_of_blocks=2, atom_indices=[0, 2, 4])["msd"]  # counted from 1
    assert np.allclose(blocks(some, "msd", "H", 2, 12), np.trace(msd(POS, [1], 12, 1, 1, 24, 2), axis1=2, axis2=3))
    long = a.get_msd(t_end_fit_dt=12, nr_of_blocks=2, stepsize_t=4, do_long=True)["msd_long"]
    rows = {r.t_idx: r.msd for r in long.where("species = 'O'").collect()}
    assert sorted(rows) == list(range(14))  # (60 - 1) // 4
    for k, value in rows.items():
        d = POS[4 * (k + 1) :, O] - POS[: 60 - 4 * (k + 1), O]
        assert np.isclose(value, (d**2).sum(axis=2).mean())


def test_several_trajectories(spark, traj):
    other = trajectory(spark, POS[:50] * 2, TYPES, VEL[:50], timestep=2.0)
    res = DynamicsAnalyzer([traj, other]).get_msd(t_end_fit_dt=12, block_length_dt=12)
    assert {(r.traj_id, r.block) for r in res["msd"].collect()} == {(0, b) for b in range(4)} | {(1, b) for b in range(3)}
    assert res.get_array("msd_isotropic_H_1").count() == 36 and res.get_array("msd_isotropic_O_mean").count() == 12
    assert res.get_array("slopes_intercepts_isotropic_O_0").count() == 4
    slopes = [r.slope for r in res["fits"].where("species = 'O'").collect()]
    assert np.isclose(res["diffusion"].where("species = 'O'").first().slope_std, np.std(slopes))


@pytest.mark.parametrize("mode", ["trapezoid", "trapezoid-simple", "simpson"])
def test_vaf(traj, mode):
    s, q, nb, nt, h = 2, 3, 2, 6, 4.0
    res = DynamicsAnalyzer(traj).get_vaf(t_start_fit_dt=4, t_end_fit_dt=12, stepsize_t=s, stepsize_tau=q, nr_of_blocks=nb, integration=mode)
    f = vaf(VEL, O, nt, s, q, 24, nb)
    assert np.allclose(blocks(res["vaf"], "vaf", "O", nb, nt), f)
    k = np.arange(nt)
    if mode == "trapezoid-simple":
        want = np.array([[np.trapezoid(g[: i + 1], dx=h) for i in range(nt)] for g in f])
    else:
        w = np.where((k == 0) | (k == nt - 1), 0.5, 1.0) if mode == "trapezoid" else np.where((k == 0) | (k == nt - 1), 1 / 3, np.where(k % 2 == 0, 4 / 3, 2 / 3))
        want = np.cumsum(f * w, axis=1) * h
    want *= 0.1 / 3
    assert np.allclose(blocks(res["vaf"], "vaf_integral", "O", nb, nt), want)
    d = want[:, 2:6].mean(axis=1)
    row = res["diffusion"].where("species = 'O'").first()
    assert np.allclose([row.diffusion_mean, row.diffusion_std, row.diffusion_sem], [d.mean(), d.std(), d.std()])


def test_vaf_options(traj):
    a = DynamicsAnalyzer(traj)
    with pytest.raises(InputError):
        a.get_vaf(t_end_fit_dt=12, integration="other")
    with pytest.raises(InputError):
        a.get_vaf(t_start_fit_dt=[0, 2], t_end_fit_dt=[3, 4])
    com, one = (a.get_vaf(t_end_fit_dt=12, nr_of_blocks=1, do_com=x)["vaf"].where("species = 'O' and t_idx = 0").first() for x in (True, False))
    assert np.isclose(com.vaf_integral, 2 * 0.1 / 3 * 0.5 * 2.0 * com.vaf) and np.isclose(one.vaf_integral, 0.1 / 3 * 0.5 * 2.0 * one.vaf)
    positions = a.get_vaf("positions", t_end_fit_dt=4, block_length_dt=20)["vaf"]
    assert positions.select("block").distinct().count() == 2


def test_kinetic(traj):
    a = DynamicsAnalyzer(traj)
    mass = np.array([1.008] * 3 + [15.999] * 2)
    e = KINETIC_FACTOR * mass * (VEL**2).sum(axis=2) / 3
    res = a.get_kinetic_energies(stepsize=7, decompose_species=True)
    assert np.allclose([r.kinetic for r in res["system"].orderBy("step").collect()], e[::7].mean(axis=1))
    assert np.allclose([r.kinetic for r in res["species"].where("species = 'O'").orderBy("step").collect()], e[::7, O].mean(axis=1))
    means = {r.species: r.mean_kinetic for r in res["means"].collect()}
    assert np.allclose([means["system"], means["H"]], [e[::7].mean(), e[::7, H].mean()])
    atoms = a.get_kinetic_energies(decompose_atoms=True, decompose_system=False)
    assert "system" not in atoms and atoms["atoms"].count() == 300
    with pytest.raises(InputError):
        a.get_kinetic_energies(decompose_atoms=True, decompose_species=True)
    with pytest.raises(KeyError):
        DynamicsAnalyzer(traj.remove_array("velocities")).get_kinetic_energies()


def test_kinetic_of_a_step_that_lacks_atoms(traj):
    from dataclasses import replace

    from driftframe.operators.kinetic import kinetic_of_system

    e = KINETIC_FACTOR * np.array([1.008] * 3 + [15.999] * 2) * (VEL**2).sum(axis=2) / 3
    e[59, 3:] = 0
    short = replace(traj, frames=traj.frames.where("step < 59 or atom_idx < 3"))
    assert np.allclose([r.kinetic for r in kinetic_of_system(short).orderBy("step").collect()], e.mean(axis=1))


def periodogram(v, fs):
    n = len(v)
    p = np.abs(np.fft.rfft(v - v.mean(axis=0), axis=0)) ** 2 / (fs * n)
    p[1 : (n + 1) // 2] *= 2
    return p


@pytest.mark.parametrize("length", [20, 15])
def test_spectrum(traj, length):
    rows = power_spectrum(traj, block_length=length).where("species = 'H'").collect()
    fs = 500.0
    for b in range(60 // length):
        want = periodogram(VEL[b * length : (b + 1) * length, H], fs).mean(axis=(1, 2))
        got = sorted((r.k, r.psd, r.freq_thz) for r in rows if r.block == b)
        assert np.allclose([g[1] for g in got], want) and np.allclose([g[2] for g in got], np.fft.rfftfreq(length, 1 / fs))


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_smoothing(traj, m):
    raw, smooth, mixed = (power_spectrum(traj, species=["O"], nr_of_blocks=3, smothening=x, mix_blocks=mix) for x, mix in ((1, False), (m, False), (m, True)))
    grid = lambda df: np.array([r.psd for r in df.orderBy("block", "k").collect()]).reshape(3, 11)
    p = grid(raw)
    want = np.array([np.convolve(row, np.ones(m) / m, "same") for row in p])
    assert np.allclose(grid(smooth), want)
    both = np.array([np.convolve(column, np.ones(3), "same") for column in want.T]).T
    assert np.allclose(grid(mixed), both)


@pytest.mark.parametrize("length", [60, 30, 12, 5, 4])
def test_mixed_blocks_are_running_totals(traj, length):
    raw, mixed = (power_spectrum(traj, species=["H"], block_length=length, mix_blocks=mix) for mix in (False, True))
    n, width = 60 // length, length // 2 + 1
    grid = lambda df: np.array([r.psd for r in df.orderBy("block", "k").collect()]).reshape(n, width)
    assert np.allclose(grid(mixed), np.array([np.convolve(column, np.ones(n), "same") for column in grid(raw).T]).T)
    # no row is given to each block of its window: the work is a sort of three rows for each
    assert "sequence(" not in mixed._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_blocks_of_trajectories_of_different_lengths(spark):
    v = RNG.normal(size=(60, 2, 3))
    t = combined([trajectory(spark, v[:m], ["H", "H"], v[:m]) for m in (60, 36)])
    found = power_spectrum(t, block_length=12, mix_blocks=True)
    raw = {(r.traj_id, r.block, r.k): r.psd for r in power_spectrum(t, block_length=12).collect()}
    for r in found.collect():
        n = (5, 3)[r.traj_id]
        assert np.isclose(r.psd, sum(raw[r.traj_id, b, r.k] for b in range(n) if r.block - n // 2 <= b <= r.block + (n - 1) // 2))
    assert found.count() == len(raw)


def test_a_sine_has_one_peak(spark):
    t = np.arange(200)
    v = np.sin(2 * np.pi * t / 10)[:, None, None] * np.ones((1, 2, 3))
    found = DynamicsAnalyzer(trajectory(spark, v, ["H", "H"], v)).get_power_spectrum(block_length_dt=100)
    peak = found["psd_stats"].orderBy("mean", ascending=False).first()
    assert np.isclose(peak.freq_thz, 100.0) and found["psd_stats"].where("mean > 1e-9").count() == 1
    with pytest.raises(InputError):
        DynamicsAnalyzer(trajectory(spark, v, ["H", "H"], v)).get_power_spectrum(block_length_dt=100, block_length_fs=3)


def test_plot_data(traj):
    a = DynamicsAnalyzer(traj)
    options = {"t_start_fit_dt": [0, 2], "t_end_fit_dt": [6, 12], "nr_of_blocks": 2}
    plot = plotdata.msd_plot(a.get_msd(**options), a.params(**options))
    assert plot["fits"].count() == 2 * 2 * 2 * 2 and plot["curves"].where("low > y or high < y").count() == 0
    spark = traj.spark
    rows = spark.createDataFrame([(1.234e-5, 2.0e-6), (1.234e-5, 1.1e-5), (1.5, float("nan")), (None, None)], "m double, e double")
    texts = [r[0] for r in rows.select(plotdata.mean_with_error(rows.m, rows.e)).collect()]
    assert texts == [r"1.23 \cdot 10^{-5} \pm 2.00 \cdot 10^{-6}", r"\left(1.23 \pm 1.10 \right)\cdot 10^{-5}", r"1.50\cdot 10^{0}", "N/A"]


def test_empty_selection_has_no_rows(traj):
    a = DynamicsAnalyzer(traj)
    assert msd_blocks(traj, a.params(t_end_fit_dt=4, species_of_interest="Xe")).count() == 0
    with pytest.raises(InputError):
        DynamicsAnalyzer().get_msd(t_end_fit_dt=3)


@pytest.mark.parametrize("stride, first, count", [(1, 1, 7), (3, 0, 4), (2, 1, 1), (5, 1, 30), (1, 0, 1), (4, 1, 0)])
def test_lag_pairs_are_all_pairs(spark, stride, first, count):
    from driftframe.operators.lag import lag_pairs

    rows = [(t, a, s) for t in range(2) for a in range(2) for s in range(23 + a) if s != 11]  # a step is missing
    one = spark.createDataFrame(rows, "traj_id int, atom_idx int, step int")
    other = one.withColumn("then", one.step)
    got = sorted((r.traj_id, r.atom_idx, r.step, r.then, r.k) for r in lag_pairs(one, other, stride, first, count).collect())
    there = set(rows)
    assert got == sorted((t, a, s, s + stride * k, k) for t, a, s in rows for k in range(first, first + count) if (t, a, s + stride * k) in there)


def test_no_lag_fits_the_stride(traj):
    a = DynamicsAnalyzer(traj)
    assert a.get_msd(t_end_fit_dt=3, stepsize_t=5)["msd"].count() == 0 and a.get_vaf(t_end_fit_dt=3, stepsize_t=5)["vaf"].count() == 0
