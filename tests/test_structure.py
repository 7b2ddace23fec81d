import math
from itertools import product

import numpy as np
import pytest
from helpers import corner_distances, trajectory

from driftframe.analyzer import RDF, AngularSpectrum
from driftframe.operators import grid, rdf
from driftframe.operators.density import gaussian_density, grid_spec
from driftframe.params import InputError
from driftframe.plans import plotdata

RNG = np.random.default_rng(11)
TYPES = ["A"] * 30 + ["B"] * 20
CUBE = ((10.0, 0, 0), (0, 9.0, 0), (0, 0, 8.0))
TRICLINIC = ((9.0, 0, 0), (1.5, 8.0, 0), (-1.0, 0.7, 10.0))


def expected(pos, cells, one, other, radius, nbins):
    same, n, volume = one == other, len(pos), abs(np.linalg.det(cells[-1]))
    counts, least = np.zeros(nbins), np.inf
    for r, c in zip(pos, cells):
        d = corner_distances(r, c)
        values = [d[i, j] for i in one for j in other if (i < j if same else i != j)]
        least = min(least, *values)
        counts += np.histogram([v for v in values if v <= radius], nbins, (0, radius))[0]
    hist = counts * (2 if same else 1) / (n * len(one))
    w = radius / nbins
    centre = (np.arange(nbins) + 0.5) * w
    return hist / (4 * np.pi * centre**2 * w) / (len(other) / volume), np.cumsum(hist), least


@pytest.mark.parametrize("cell", [CUBE, TRICLINIC, None])
def test_rdf(spark, cell):
    pos = RNG.uniform(-12, 12, size=(3, 50, 3))
    cells = np.array([np.array(TRICLINIC) * (1 + 0.05 * k) for k in range(3)]) if cell is None else np.array([cell] * 3)
    t = trajectory(spark, pos, TYPES, cell=cell, cells=cells if cell is None else None)
    a, b = list(range(30)), list(range(30, 50))
    res = RDF(t).run(2.4, [("A", "A"), ("A", "B"), ("B", [0, "B"])], nbins=12)
    for label, one, other in (("A_A", a, a), ("A_B", a, b), ("B_spec_2", b, [0, *b])):
        g, integral, least = expected(pos, cells, one, other, 2.4, 12)
        rows = res["rdf"].where(f"label = '{label}'").orderBy("bin").collect()
        assert np.allclose([r.rdf for r in rows], g) and np.allclose([r.integral for r in rows], integral), label
        assert np.isclose(res["summary"].where(f"label = '{label}'").first().shortest, least)


def test_rdf_options(spark):
    pos = RNG.uniform(0, 8, size=(9, 50, 3))
    t = trajectory(spark, pos, TYPES, cell=CUBE)
    rows = rdf.rdf(t, 3.0, [("A", "B")], istart=1, istop=7, stepsize=3, nbins=6).orderBy("bin").collect()
    g, integral, _ = expected(pos[[1, 4]], [np.array(CUBE)] * 2, list(range(30)), list(range(30, 50)), 3.0, 6)
    assert np.allclose([r.rdf for r in rows], g) and np.allclose([r.integral for r in rows], integral)
    assert {r.label for r in rdf.rdf(t, 1.0, nbins=2).collect()} == {"A_A", "A_B", "B_B"}
    assert {r.label for r in rdf.rdf(t, 1.0, [(3, 3), (3, "B")], nbins=2).collect()} == {"3_B"}  # an atom has no pair with itself
    far = rdf.rdf_summary(trajectory(spark, np.array([[[0, 0, 0], [4.0, 0, 0]]]), ["A", "B"], cell=CUBE), 0.5, [("A", "B")]).first()
    assert np.isclose(far.shortest, 4.0) and far.n_pairs == 1
    with pytest.raises(InputError):
        rdf.rdf(t, 1.0, istop=9)
    with pytest.raises(InputError):
        rdf.rdf(t, 1.0, [("A", "Xe")])
    with pytest.raises(NotImplementedError):
        RDF(t).run_fort()
    with pytest.raises(KeyError):
        rdf.rdf(trajectory(spark, pos, TYPES), 1.0)


def test_simple_cubic_lattice(spark):
    sites = np.array(list(product(range(4), repeat=3)), float)
    t = trajectory(spark, sites[None], ["Po"] * 64, cell=((4.0, 0, 0), (0, 4.0, 0), (0, 0, 4.0)))
    rows = {r.bin: r.integral for r in rdf.rdf(t, 1.9, nbins=38).collect()}
    assert np.allclose([rows[19], rows[20], rows[27], rows[28], rows[33], rows[34], rows[37]], [0, 6, 6, 18, 18, 26, 26])  # shells at 1, sqrt 2, sqrt 3


def mirrored(d, cell):
    f = np.fmod(d @ np.linalg.inv(cell), 1.0)
    f = np.where(f < -0.5, f + 1, np.where(f > 0.5, 1 - f, f))
    return f @ cell


@pytest.mark.parametrize("fixed", [False, True])
def test_angular(spark, fixed):
    pos = RNG.uniform(-12, 12, size=(2, 50, 3))
    t = trajectory(spark, pos, TYPES, cell=CUBE)
    cell, want = np.array(CUBE), np.zeros(18)
    for r in pos:
        for i in range(30):
            d = r - r[i]
            d = (lambda f: (f - np.round(f)) @ cell)(d @ np.linalg.inv(cell)) if fixed else mirrored(d, cell)
            near = [j for j in range(50) if j != i and np.linalg.norm(d[j]) <= 2.6]
            for j, k in product([j for j in near if j < 30], [k for k in near if k >= 30]):
                c = d[j] @ d[k] / np.linalg.norm(d[j]) / np.linalg.norm(d[k])
                b = int(math.degrees(math.acos(max(-1, min(1, c)))) / 10 + 0.5)
                if 1 <= b <= 18:
                    want[b - 1] += 1 / (d[j] @ d[j]) / (d[k] @ d[k]) / (2 * 30)
    rows = AngularSpectrum(t).run(2.6, [("A", "A", "B")], nbins=18, fixed=fixed)["angular"].orderBy("bin").collect()
    assert np.allclose([r.value for r in rows], want) and [r.angle for r in rows] == [10.0 * k for k in range(1, 19)]
    assert want.sum() > 0
    assert plotdata.angular_plot(t.spark.createDataFrame([("A_B_C", 1.0, 2.0)], "label string, angle double, value double")).first().label == "B-A-C"


def test_angular_refuses(spark):
    pos = RNG.uniform(0, 8, size=(2, 50, 3))
    with pytest.raises(InputError):
        rdf.angular_spectrum(trajectory(spark, pos, TYPES, cell=TRICLINIC), 2.0)
    assert {r.label for r in rdf.angular_spectrum(trajectory(spark, pos, TYPES, cell=CUBE), 1.0, nbins=2).collect()} == {"A_A_A", "A_A_B", "A_B_B", "B_B_B"}


def test_nearest_bin(spark):
    pos = RNG.uniform(-5, 12, size=(2, 50, 3))
    t = trajectory(spark, pos, TYPES, cell=CUBE)
    cell, w, counts = np.array(CUBE), 0.3, np.zeros(11)
    for r in pos:
        for i in range(30):
            for d in np.linalg.norm(mirrored(r[30:] - r[i], cell), axis=1):
                b = int(d / w + 0.5)
                counts[b if b <= 10 else 0] += 1 / (2 * 30)
    rows = rdf.rdf_nearest_bin(t, 3.0, "A", "B", nbins=10).orderBy("bin").collect()
    b = np.arange(1, 11)
    shell = 4 / 3 * np.pi * np.where(b == 1, 3.25 * w**3, 3 * (b * w) ** 2 * w + 0.75 * w**3)
    assert np.allclose([r.rdf for r in rows], counts[1:] / shell / (20 / 720)) and np.allclose([r.integral for r in rows], np.cumsum(np.where(b > 1, counts[1:], 0)))


def test_density(spark):
    cell = np.diag([2.0, 2.5, 3.0])
    pos = RNG.uniform(-4, 4, size=(3, 4, 3))
    t = trajectory(spark, pos, ["H", "H", "O", "H"], cell=tuple(map(tuple, cell)))
    spec = grid_spec(cell, 0.4, 2.0, 0.5)
    assert spec.shape == (5, 6, 7) and spec.reach == (2, 2, 2)
    want = np.zeros(spec.shape)
    for r in pos[[0, 2]][:, [0, 1, 3]].reshape(-1, 3):
        f = np.fmod(r @ np.linalg.inv(cell), 1.0)
        f = np.where(f < 0, f + 1, f)
        i0 = (f * spec.shape).astype(int) + 1
        for s in product(*[range(i - b, i + b + 1) for i, b in zip(i0, spec.reach)]):
            d = (np.array(s) / spec.shape - f) @ cell
            want[tuple((np.array(s) - 1) % spec.shape)] += math.exp(-(d @ d) / (2 * 0.4**2))
    want *= 3 / (want.sum() * 15.0 / 210)
    dens = gaussian_density(t, "H", spec, stepsize=2)
    got = np.zeros(spec.shape)
    for r in dens.collect():
        got[r.ix, r.iy, r.iz] = r.value
    assert np.allclose(got, want)
    assert gaussian_density(t, "H", spec, atom_indices=[4]).groupBy().sum("value").first()[0] * 15 / 210 == pytest.approx(1.0)
    with pytest.raises(InputError):
        gaussian_density(t, "Xe", spec)
    with pytest.raises(InputError):
        gaussian_density(t, "H", grid_spec(TRICLINIC, 0.4, 2.0, 2.0))


def test_grids(spark):
    g = spark.createDataFrame([(x, y, z, float(x + 2 * y + 4 * z)) for x, y, z in product(range(2), range(2), range(2))], "ix int, iy int, iz int, value double")
    assert grid.padded(g, (2, 2, 2)).count() == 27 and grid.tiled(g, (2, 2, 2), (2, 3, 1)).count() == 48
    assert {(r.ix, r.iy, r.iz): r.value for r in grid.padded(g, (2, 2, 2)).collect()}[2, 1, 2] == 2.0
    s = grid.summary(g).first()
    assert (s.least, s.most, s.total, s.mean) == (0, 7, 28, 3.5) and np.isclose(s.std, np.std(np.arange(8)))
    d = grid.difference(g, g.where("ix = 0")).where("value <> 0")
    assert d.count() == 4 and grid.dense(g.where("value > 5"), (2, 2, 2)).where("value = 0").count() == 6
    logs = {r.value for r in grid.log_density(g).collect()}
    assert -120.0 in logs and math.log10(7) in logs
