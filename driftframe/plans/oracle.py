"""DuckDB SQL for the registered engine queries, written from the formulas and not from the Spark plans."""

from __future__ import annotations

from itertools import combinations_with_replacement

from driftframe.functions.constants import BOHR_IN_ANGSTROM, ELEMENTS, KINETIC_FACTOR
from driftframe.plans.views import ATOMS, CELLS, EMB, EV, GRID, HALVES

DT = 2.0
RADIUS = 0.45
EV_ROWS = "traj_id, step, atom_idx"


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded, exact ties up, without negative zeros."""
    v = f"round({expr} + 1e-{digits + 3}, {digits})"
    return f"case when {v} = 0 then 0.0::double else {v} end as {name}"


def with_(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def rows(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names.split())


# -- correlation ---------------------------------------------------------------------------------


def blocks(view: str, t_end: int, number: int | None = 2, length: int | None = None) -> str:
    per = f"select traj_id, max(step) + 1 - {t_end} as room from {view} group by traj_id"
    if length is None:
        return f"p as (select traj_id, cast(floor(room/{number}) as int) as b, {number} as nb from ({per}))"
    return f"p as (select traj_id, {length} as b, cast(floor(room/{length}) as int) as nb from ({per}))"


def lagged(view: str, s: int, first: int, last: int, q: int, products: str, extra: str = "") -> str:
    """Pairs k = first..last of origins inside blocks, grouped."""
    return f"""select t.type as species, a.traj_id, cast(floor(a.step/p.b) as int) as block, cast((b.step-a.step)/{s} as int) as k, p.b, {products}
from {view} a join {view} b on a.traj_id = b.traj_id and a.atom_idx = b.atom_idx and b.step >= a.step + {first*s} and b.step <= a.step + {last*s} and (b.step - a.step) % {s} = 0
join p on p.traj_id = a.traj_id join atoms10 t on t.atom_idx = a.atom_idx
where a.step < p.b*p.nb and (a.step % p.b) % {q} = 0 {extra} group by all"""


ISO = "sum((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2) as s"


def msd(view: str = "traj_ev", prelude: tuple = (EV,), s: int = 1, q: int = 1, number: int | None = 2, length: int | None = None, extra: str = "", sizes: str = "sizes") -> str:
    lags = 20 // s
    return with_(*prelude, ATOMS, blocks(view, 20, number, length), f"m as ({lagged(view, s, 1, lags, q, ISO, extra)})", f"msd as (select species, traj_id, block, k - 1 as t_idx, (k - 1)*{DT * s} as t_fs, k*{s} as lag_dt, s*{q}/(b*n) as msd from m join {sizes} z on z.type = m.species)")


MSD_OUT = f"select species, traj_id, block, t_idx, cast(t_fs as double) as t_fs, lag_dt, {r('msd', 'msd', 5)} from msd"


def decomposed() -> str:
    products = ", ".join(f"sum((b.{i}-a.{i})*(b.{j}-a.{j})) as s_{i}{j}" for i in "xyz" for j in "xyz")
    out = " union all ".join(f"select species, traj_id, block, k - 1 as t_idx, (k - 1)*{DT} as t_fs, k as lag_dt, '{i}' as i, '{j}' as j, s_{i}{j}/(b*n) as msd from m join sizes z on z.type = m.species" for i in "xyz" for j in "xyz")
    return with_(EV, ATOMS, blocks("traj_ev", 20), f"m as ({lagged('traj_ev', 1, 1, 20, 1, products)})", f"msd as ({out})")


def stats(value: str, name: str = "", digits: int = 4) -> str:
    return f"{r(f'avg({value})', f'{name}mean', digits)}, {r(f'stddev_pop({value})', f'{name}std', digits)}, {r(f'stddev_pop({value})/sqrt(count(*)-1)', f'{name}sem', digits)}"


def fits(windows: list[tuple[int, int]], by: str) -> str:
    table = " union all ".join(f"select {i} as fit_idx, {a} as fa, {b} as fb" for i, (a, b) in enumerate(windows))
    return f"w as ({table}), fits as (select {by}, cast(fit_idx as int) as fit_idx, regr_slope(msd, t_fs) as slope, regr_intercept(msd, t_fs) as intercept from msd, w where t_idx >= fa and t_idx < fb group by all)"


def diffusion(by: str, factor: float) -> str:
    parts = ", ".join(r(f"{factor}*({e})", f"diffusion_{n}_cm2_s", 4) for n, e in (("mean", "avg(slope)"), ("std", "stddev_pop(slope)"), ("sem", "stddev_pop(slope)/sqrt(count(*)-1)")))
    return f"select {by}, fit_idx, {stats('slope', 'slope_')}, {parts} from fits group by {by}, fit_idx"


COM = "com as (select traj_id, step, 0 as atom_idx, sum(x*mass)/sum(mass) as x, sum(y*mass)/sum(mass) as y, sum(z*mass)/sum(mass) as z from traj_ev join atoms10 using (atom_idx) group by traj_id, step)"
COM_V = "com as (select traj_id, step, 0 as atom_idx, sum(vx*mass)/sum(mass) as vx, sum(vy*mass)/sum(mass) as vy, sum(vz*mass)/sum(mass) as vz from traj_emb join atoms10 using (atom_idx) group by traj_id, step)"


def vaf(view: str = "traj_emb", v: str = "v", s: int = 1, q: int = 1, mode: str = "trapezoid", prelude: tuple = (EMB,), com: bool = False) -> str:
    lags, h = 10 // s, DT * s
    product = f"avg(a.{v}x*b.{v}x + a.{v}y*b.{v}y + a.{v}z*b.{v}z) as vaf"
    ends = f"k = 0 or k = {lags - 1}"
    weight = {"trapezoid": f"case when {ends} then 0.5 else 1 end * vaf", "simpson": f"case when {ends} then 1.0/3 when k % 2 = 0 then 4.0/3 else 2.0/3 end * vaf", "simple": "case when k = 0 then 0 else 0.5*(vaf + prev) end"}[mode]
    source = "select sz.type as species, m.* exclude (species), sz.n as scale from m, sizes sz" if com else "select *, 1.0 as scale from m"
    return with_(*prelude, ATOMS, *((COM_V,) if com else ()), blocks(view, 10), f"m as ({lagged(view, s, 0, lags - 1, q, product)})", f"m2 as (select *, lag(vaf) over (partition by species, traj_id, block order by k) as prev from ({source}))",
                 f"vaf as (select species, traj_id, block, k as t_idx, cast(k*{h} as double) as t_fs, vaf, 0.1/3*scale*{h}*sum({weight}) over (partition by species, traj_id, block order by k) as vaf_integral from m2)")


VAF_OUT = f"select species, traj_id, block, t_idx, t_fs, {r('vaf', 'vaf', 8)}, {r('vaf_integral', 'vaf_integral', 8)} from vaf"

KINETIC = f"e as (select traj_id, step, atom_idx, type, {KINETIC_FACTOR!r}/3*mass*(vx*vx+vy*vy+vz*vz) as e from traj_emb join atoms10 using (atom_idx))"


def velocities() -> str:
    def one(c):
        b, a = f"lag({c}) over w", f"lead({c}) over w"
        return f"case when {b} is null then ({a}-{c})/{DT} when {a} is null then ({c}-{b})/{DT} else ({a}-{b})/{2 * DT} end as v{c}"

    return f"vel as (select traj_id, step, atom_idx, {', '.join(map(one, 'xyz'))} from traj_ev window w as (partition by traj_id, atom_idx order by step))"


def psd() -> str:
    """An explicit Fourier sum over blocks of 50 steps; the sampling frequency is 500."""
    axes = " union all ".join(f"select traj_id, atom_idx, cast(floor(step/50) as int) as block, step % 50 as n, '{c}' as axis, v{c} as v from vel" for c in "xyz")
    return with_(EV, ATOMS, velocities(), f"vs as ({axes})", "full_ as (select cast(floor((max(step)+1)/50) as int) as nb from traj_ev)", "m as (select vs.*, v - avg(v) over (partition by traj_id, atom_idx, block, axis) as d from vs, full_ where block < nb)",
                 "ks as (select cast(range as int) as k from range(26))", "f as (select traj_id, atom_idx, block, k, axis, (power(sum(d*cos(2*pi()*k*n/50)), 2) + power(sum(d*sin(2*pi()*k*n/50)), 2))/(500.0*50)*case when k in (0, 25) then 1 else 2 end as p from m, ks group by traj_id, atom_idx, block, k, axis)",
                 "psd as (select type as species, traj_id, block, k, k*500.0::double/50 as freq_thz, avg(p) as psd from f join atoms10 using (atom_idx) group by all)")


# -- pairs ----------------------------------------------------------------------------------------


def wrapped(c: str, cell: str) -> str:
    f = f"((b.{c}-a.{c})/{cell} - floor((b.{c}-a.{c})/{cell}))"
    return f"power(least({f}, 1-{f})*{cell}, 2)"


def pairs(a: str, b: str, same: bool, variable: bool = False, limit: float | None = RADIUS) -> str:
    """Distances of pairs, for axes at right angles."""
    ax, by, cz = ("c.ax", "c.by_", "c.cz") if variable else ("1.0", "1.0", "1.0")
    dist = f"sqrt({wrapped('x', ax)} + {wrapped('y', by)} + {wrapped('z', cz)})"
    cells = "join cells_emb c on c.step = a.step" if variable else ""
    where = f"where d <= {limit}" if limit is not None else ""
    return f"select * from (select a.step, a.atom_idx as i, b.atom_idx as j, {dist} as d from traj_emb a join traj_emb b on a.step = b.step and a.atom_idx {'<' if same else '<>'} b.atom_idx {cells} join atoms10 ta on ta.atom_idx = a.atom_idx join atoms10 tb on tb.atom_idx = b.atom_idx where {a.replace('@', 'ta.')} and {b.replace('@', 'tb.')}) {where}"


def species(s: str) -> str:
    return f"@type = '{s}'"


DEFAULT_PAIRS = [("H", "H"), ("H", "Li"), ("H", "O"), ("Li", "Li"), ("Li", "O"), ("O", "O")]
COUNT = {"H": 5, "O": 3, "Li": 2}


def rdf_of(parts: list[tuple[str, str, str, int, int, bool]], variable: bool, columns: str) -> str:
    """parts: label, both filters, both sizes, whether the pair is of one set."""
    volume = "(select arg_max(ax*by_*cz, step) from cells_emb)" if variable else "1.0"
    w = RADIUS / 15
    out = " union all ".join(
        f"select '{label}' as label, g.bin, (g.bin + 0.5)*{w!r} as radius, coalesce(h.n, 0)*{2.0 if same else 1.0}/((select count(distinct step) from traj_emb)*{n1}) as hist, {n2} as n2 "
        f"from (select cast(range as int) as bin from range(15)) g left join (select least(cast(floor(d/{w!r}) as int), 14) as bin, count(*) as n from ({pairs(a, b, same, variable)}) group by 1) h on h.bin = g.bin"
        for label, a, b, n1, n2, same in parts
    )
    chosen = {"rdf": r(f"hist/(4*pi()*{w!r}*radius*radius)/(n2/{volume})", "rdf"), "integral": r("sum(hist) over (partition by label order by bin)", "integral")}
    return with_(EMB, ATOMS, CELLS, f"o as ({out})") + f"select label, bin, {r('radius', 'radius')}, {', '.join(chosen[c] for c in columns.split())} from o"


def default_parts() -> list:
    return [(f"{a}_{b}", species(a), species(b), COUNT[a], COUNT[b], a == b) for a, b in DEFAULT_PAIRS]


def mirrored(p: str, q: str) -> str:
    """Fraction per axis: remainder with its sign, over a half taken to 1 - f."""
    def one(c):
        f = f"(({q}.{c}-{p}.{c}) - trunc({q}.{c}-{p}.{c}))"
        return f"case when {f} < -0.5 then {f} + 1 when {f} > 0.5 then 1 - {f} else {f} end as d{c}"

    return ", ".join(map(one, "xyz"))


NEAREST = f"n as (select a.step, a.atom_idx as i, b.atom_idx as j, ta.type as ti, tb.type as tj, {mirrored('a', 'b')} from traj_emb a join traj_emb b on a.step = b.step and a.atom_idx <> b.atom_idx join atoms10 ta on ta.atom_idx = a.atom_idx join atoms10 tb on tb.atom_idx = b.atom_idx), n2 as (select *, sqrt(dx*dx+dy*dy+dz*dz) as d from n)"


#: The species of angular_default, twice each.
FIVE = ("H", "O", "Li", "C", "N")
ATOMS_FIVE = f"atoms10 as (select cast(range as int) as atom_idx, ({list(FIVE)})[range % 5 + 1] as type from range(10))"


def angular(triples: list[tuple[str, str, str]], atoms: str = ATOMS, count: dict[str, int] = COUNT) -> str:
    cosine = "(a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)/(a.d*b.d)"
    out = " union all ".join(
        f"select '{x}_{y}_{z}' as label, g.bin, g.bin*10.0::double as angle, coalesce(s, 0.0)/((select max(step)+1 from traj_emb)*{count[x]}) as value from (select cast(range as int) as bin from range(1, 19)) g left join "
        f"(select cast(round(degrees(acos(greatest(-1, least(1, {cosine}))))/10) as int) as bin, sum(1/(a.d*a.d*b.d*b.d)) as s from n2 a join n2 b on a.step = b.step and a.i = b.i and a.j <> b.j where a.ti = '{x}' and a.tj = '{y}' and b.tj = '{z}' and a.d <= {RADIUS} and b.d <= {RADIUS} group by 1) h on h.bin = g.bin"
        for x, y, z in triples
    )
    return with_(EMB, atoms, NEAREST, f"o as ({out})") + f"select label, bin, angle, {r('value', 'value', 4)} from o"


def density(kind: str) -> str:
    """5 points along each axis of the unit cube, stencil of 3 points, sigma 0.1."""
    f = ", ".join(f"case when {c} - trunc({c}) < 0 then {c} - trunc({c}) + 1 else {c} - trunc({c}) end as f{c}" for c in "xyz")
    s = ", ".join(f"cast(floor(f{c}*5) as int) + 1 + s{c}.o as i{c}" for c in "xyz")
    return with_(EMB, ATOMS, f"f as (select {f} from traj_emb join atoms10 using (atom_idx) where type = '{kind}')", "o as (select cast(range as int) - 3 as o from range(7))", f"s as (select f.*, {s} from f, o sx, o sy, o sz)",
                 "g as (select cast((ix+49) % 5 as int) as ix, cast((iy+49) % 5 as int) as iy, cast((iz+49) % 5 as int) as iz, sum(exp(-(power(s.ix/5.0-fx, 2)+power(s.iy/5.0-fy, 2)+power(s.iz/5.0-fz, 2))/0.02)) as w from s group by all)",
                 f"dens as (select ix, iy, iz, w*{COUNT[kind]}*125.0/(select sum(w) from g) as value from g)")


SUMMARY = f"select {r('min(value)', 'least')}, {r('max(value)', 'most')}, {r('sum(value)', 'total')}, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}"


def sql() -> dict[str, str]:
    xyz = "x y z"
    centre = lambda cols, w="mass", where="": ", ".join(f"sum({c}*{w})/sum({w}) as {c}" for c in cols.split())
    out = {
        "indices_of_species": with_(EV, ATOMS) + "select traj_id, atom_idx, count(*) as n_steps from traj_ev join atoms10 using (atom_idx) where type = 'O' or atom_idx = 9 group by all",
        "atom_counts": with_(EV, ATOMS) + "select type as species, count(distinct atom_idx) as n_atoms, count(*) as n_rows from traj_ev join atoms10 using (atom_idx) group by 1",
        "volumes": with_(EMB, CELLS) + f"select traj_id, step, {r('ax*by_*cz', 'volume')} from cells_emb",
        "rescale_positions": with_(EV) + f"select {EV_ROWS}, {', '.join(r(f'{c}*{BOHR_IN_ANGSTROM!r}', c) for c in 'xyz')} from traj_ev",
        "set_and_remove_arrays": with_(EMB) + f"select {EV_ROWS}, {r('x', 'x')}, {r('2*vx', 'fx')}, {r('2*vy', 'fy')}, {r('2*vz', 'fz')}, {r('x+y', 'charge')} from traj_emb",
        "recenter_mass": with_(EMB, ATOMS) + f"select {EV_ROWS}, {', '.join(r(f'{c} - sum({c}*mass) over w / sum(mass) over w', c) for c in 'x y z vx vy vz'.split())}, {rows('fx fy fz')} from traj_emb join atoms10 using (atom_idx) window w as (partition by traj_id, step)",
        "recenter_geometric": with_(EV) + f"select {EV_ROWS}, {', '.join(r(f'{c} - avg({c}) over w', c) for c in 'xyz')} from traj_ev window w as (partition by traj_id, step)",
        "recenter_sublattice": with_(EV, ATOMS, "l as (select *, case when type = 'O' or atom_idx = 0 then mass else 0 end as m from traj_ev join atoms10 using (atom_idx))") + f"select {EV_ROWS}, {', '.join(r(f'{c} - sum({c}*m) over w / sum(m) over w', c) for c in 'xyz')} from l window w as (partition by traj_id, step)",
        "com_positions": with_(EMB, ATOMS, f"c as (select traj_id, step, {centre(xyz)} from traj_emb join atoms10 using (atom_idx) group by all)") + f"select traj_id, step, {rows(xyz)} from c",
        "com_velocities": with_(EMB, ATOMS, f"c as (select traj_id, step, {centre('vx vy vz')} from traj_emb join atoms10 using (atom_idx) group by all)") + f"select traj_id, step, {rows('vx vy vz')} from c",
        "com_sublattice": with_(EMB, ATOMS, f"c as (select traj_id, step, {centre(xyz, '1.0')} from traj_emb join atoms10 using (atom_idx) where type = 'Li' group by all)") + f"select traj_id, step, {rows(xyz)} from c",
        "velocity_central_diff": with_(EV, velocities()) + f"select {EV_ROWS}, {rows('vx vy vz')} from vel",
        "frame_slice": with_(EV) + f"select {EV_ROWS}, {rows(xyz)} from traj_ev where step >= 7 and step < 90 and (step - 7) % 3 = 0",
        "snapshot": with_(EMB, ATOMS) + f"select {EV_ROWS}, {rows('x y z vx vy vz')}, type, {r('mass', 'mass')} from traj_emb join atoms10 using (atom_idx) where step = 17",
        "msd_blocks": msd() + MSD_OUT, "msd_blocks_tau": msd(s=2, q=3) + MSD_OUT, "msd_block_length": msd(number=None, length=30) + MSD_OUT,
        "msd_decomposed": decomposed() + f"select species, traj_id, block, t_idx, cast(t_fs as double) as t_fs, lag_dt, i, j, {r('msd', 'msd', 5)} from msd",
        "msd_long": with_(EV, ATOMS) + f"select t.type as species, a.traj_id, cast(b.step-a.step-1 as int) as t_idx, cast((b.step-a.step-1)*{DT} as double) as t_fs, {r('avg((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2)', 'msd', 5)} from traj_ev a join traj_ev b on a.atom_idx = b.atom_idx and b.step > a.step and b.step <= a.step + 30 join atoms10 t on t.atom_idx = a.atom_idx group by 1, 2, b.step - a.step",
        "msd_atom_subset": msd(extra="and a.atom_idx + 1 in (1, 3, 6, 7)", sizes="(select type, cast(count(*) as double) as n from atoms10 where atom_idx + 1 in (1, 3, 6, 7) group by type)") + MSD_OUT,
        "msd_com": with_(EV, ATOMS, COM, blocks("com", 20), f"m as ({lagged('com', 1, 1, 20, 1, ISO)})", f"msd as (select z.type as species, traj_id, block, k - 1 as t_idx, (k - 1)*{DT} as t_fs, k as lag_dt, s/b*n as msd from m, sizes z)") + MSD_OUT,
        "msd_multi_traj": msd("traj_2", (EV, HALVES), number=1) + MSD_OUT,
        "msd_stats": msd() + f"select species, t_idx, cast(t_fs as double) as t_fs, {stats('msd')} from msd group by species, t_idx, t_fs",
        "msd_fits": msd() + f", {fits([(5, 20)], 'species, traj_id, block')} select species, traj_id, block, fit_idx, {rows('slope intercept', 4)} from fits",
        "msd_multi_fit": msd() + f", {fits([(0, 10), (8, 20)], 'species, traj_id, block')} select species, traj_id, block, fit_idx, {rows('slope intercept', 4)} from fits",
        "diffusion_iso": msd() + f", {fits([(5, 20)], 'species, traj_id, block')} {diffusion('species', 0.1 / 6)}",
        "diffusion_decomposed": decomposed() + f", {fits([(5, 20)], 'species, traj_id, block, i, j')} {diffusion('species, i, j', 0.1 / 2)}",
        "vaf_blocks": vaf() + VAF_OUT, "vaf_integral_trapezoid": vaf(s=2) + VAF_OUT, "vaf_integral_trapezoid_simple": vaf(mode="simple") + VAF_OUT, "vaf_integral_simpson": vaf(mode="simpson") + VAF_OUT,
        "vaf_of_forces": vaf(v="f", q=2) + VAF_OUT, "vaf_stats": vaf() + f"select species, t_idx, t_fs, {stats('vaf', '', 8)} from vaf group by species, t_idx, t_fs",
        "vaf_diffusion": vaf() + f", d as (select species, block, avg(vaf_integral) as d from vaf where t_idx >= 2 and t_idx < 10 group by all) select species, {stats('d', 'diffusion_', 8)} from d group by species",
        "vaf_com": vaf("com", com=True) + VAF_OUT,
        "kinetic_system": with_(EMB, ATOMS, KINETIC) + f"select traj_id, step, {r('sum(e)/10', 'kinetic', 3)} from e where step % 2 = 0 group by traj_id, step",
        "kinetic_species": with_(EMB, ATOMS, KINETIC) + f"select traj_id, step, type as species, {r('sum(e)/count(*)', 'kinetic', 3)} from e group by traj_id, step, type",
        "kinetic_atoms": with_(EMB, ATOMS, KINETIC) + f"select {EV_ROWS}, {r('e', 'kinetic', 3)} from e",
        "kinetic_means": with_(EMB, ATOMS, KINETIC, "s as (select traj_id, step, type as species, sum(e)/count(*) as k from e group by all union all select traj_id, step, 'system', sum(e)/10 from e group by all)") + f"select traj_id, species, {r('avg(k)', 'mean_kinetic', 3)} from s group by all",
        "psd_blocks": psd() + f"select species, traj_id, block, k, {r('freq_thz', 'freq_thz', 4)}, {r('psd', 'psd', 4)} from psd",
        "psd_smoothed": psd() + f"select species, traj_id, block, k, {r('freq_thz', 'freq_thz', 4)}, {r('sum(psd) over (partition by species, traj_id, block order by k rows between 2 preceding and 1 following)/4', 'psd', 4)} from psd",
        "psd_stats": psd() + f"select species, k, {r('freq_thz', 'freq_thz', 4)}, {stats('psd')} from psd group by species, k, freq_thz",
        "psd_mixed_blocks": psd() + f", sm as (select *, sum(psd) over (partition by species, traj_id, block order by k rows between 1 preceding and 1 following)/3 as v from psd), nb as (select max(block) + 1 as nb from psd) "
        f"select a.species, a.traj_id, a.block, a.k, {r('a.freq_thz', 'freq_thz', 4)}, {r('sum(b.v)', 'psd', 4)} from sm a, nb, sm b where b.species = a.species and b.traj_id = a.traj_id and b.k = a.k and b.block >= a.block - nb // 2 and b.block <= a.block + (nb - 1) // 2 group by a.species, a.traj_id, a.block, a.k, a.freq_thz",
        "rdf_hist": with_(EMB, ATOMS) + f"select 'H_O' as label, least(cast(floor(d/{RADIUS / 15!r}) as int), 14) as bin, count(*) as n from ({pairs(species('H'), species('O'), False)}) group by all",
        "rdf_norm": rdf_of(default_parts(), False, "rdf"), "rdf_integral": rdf_of(default_parts(), False, "integral"), "rdf_variable_cell": rdf_of(default_parts(), True, "rdf integral"),
        "rdf_pair_list": rdf_of([("spec_0_H", "(@atom_idx = 0 or @type = 'Li')", species("H"), 3, 5, False), ("2_O", "@atom_idx = 2", species("O"), 1, 3, False)], False, "rdf integral"),
        "rdf_shortest": with_(EMB, ATOMS) + " union all ".join(f"select '{a}_{b}' as label, {r('min(d)', 'shortest')}, cast({COUNT[a] * (COUNT[a] - 1) // 2 if a == b else COUNT[a] * COUNT[b]} as bigint) as n_pairs, (select count(distinct step) from traj_emb) as n_data from ({pairs(species(a), species(b), a == b, limit=None)})" for a, b in DEFAULT_PAIRS),
        "rdf_nearest_bin": with_(EMB, ATOMS, NEAREST, f"o as (select g.bin, g.bin*{RADIUS / 15!r}::double as radius, coalesce(h.n, 0)::double/((select max(step)+1 from traj_emb)*5) as c from (select cast(range as int) as bin from range(1, 16)) g left join (select cast(round(d/{RADIUS / 15!r}) as int) as bin, count(*) as n from n2 where ti = 'H' and tj = 'O' group by 1) h on h.bin = g.bin)")
        + f"select bin, {r('radius', 'radius')}, {r(f'c/3.0/(4*pi()/3*case when bin = 1 then 3.25*power({RADIUS / 15!r}, 3) else 3*radius*radius*{RADIUS / 15!r} + 0.75*power({RADIUS / 15!r}, 3) end)', 'rdf')}, {r('coalesce(sum(case when bin > 1 then c end) over (order by bin), 0)', 'integral')} from o",
        "angular_spectrum": angular([("O", "H", "H"), ("H", "Li", "O")]),
        "angular_default": angular(list(combinations_with_replacement(sorted(FIVE), 3)), ATOMS_FIVE, dict.fromkeys(FIVE, 2)),
        "angular_plot": f"select case label when 'O_H_H' then 'H-O-H' else 'Li-H-O' end as label, angle as x, value as y from ({angular([('O', 'H', 'H'), ('H', 'Li', 'O')])})",
        "rdf_plot": f"select label, radius as x, rdf as y, integral from ({rdf_of(default_parts(), False, 'rdf integral')})",
        "spectrum_plot": psd() + f", s as (select species, freq_thz, avg(psd) as m, stddev_pop(psd)/sqrt(count(*)-1) as e from psd group by species, freq_thz) select species, {r('freq_thz', 'x', 4)}, {r('m', 'y', 4)}, {r('m-e', 'low', 4)}, {r('m+e', 'high', 4)} from s",
        "vaf_plot_curves": vaf() + f", s as (select species, t_fs, avg(vaf) as m, stddev_pop(vaf)/sqrt(count(*)-1) as e from vaf group by species, t_fs) select species, cast(t_fs as double) as x, {r('m', 'y', 8)}, {r('m-e', 'low', 8)}, {r('m+e', 'high', 8)} from s",
        "vaf_plot_marks": f"select cast(0 as int) as fit_idx, cast(x*{DT} as double) as x from (values (2), (10)) v(x)",
        "dump_many_files": _dump(1, 1, 1),
        "thermo_file": 'select cast(o_orderkey as bigint) as "TimeStep", o_custkey + 0.5::double as "PotEng", 1.0::double as "Nth" from orders',
        "xsf_scientific": with_(GRID) + f"select ix, iy, iz, {r('floor(value) % 90000 + 1', 'value')} from grid10",
        "density_grid": density("H") + f"select ix, iy, iz, {r('value', 'value')} from dens", "density_total": density("O") + SUMMARY + " from dens",
        "grid_difference": with_(GRID) + f"select ix, iy, iz, {r('value - case when value > 20 then value*0.5 else 0 end', 'value')} from grid10",
        "grid_tile": with_(GRID) + f"select cast(ix + 10*a.range as int) as ix, iy, cast(iz + 10*b.range as int) as iz, {r('value', 'value')} from grid10, range(2) a, range(3) b",
        "grid_pad": with_(GRID, "p as (select cast(range as int) as i from range(11))") + f"select a.i as ix, b.i as iy, c.i as iz, {r('value', 'value')} from p a, p b, p c, grid10 g where g.ix = a.i % 10 and g.iy = b.i % 10 and g.iz = c.i % 10",
        "grid_summary": with_(GRID) + SUMMARY + " from grid10",
        "grid_log": with_(GRID) + f"select ix, iy, iz, {r('case when value - 20 > 0 then log10(greatest(value - 20, 1e-300)) else -120.0::double end', 'value', 5)} from grid10",
        "thermo_join": f"select distinct cast(l_orderkey as bigint) as raw_timestep, {r('cast(o_totalprice as double)*0.5', 'potential_energy', 4)}, {r('cast(o_custkey as double)', 'Temp', 4)} from lineitem join orders on o_orderkey = l_orderkey",
        "thermo_first_row": 'select cast(l_orderkey as bigint) as "TimeStep", cast(l_linenumber as bigint) as line, cast(l_partkey as bigint) as part, cast(l_suppkey as bigint) as supp from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem) where rn = 1',
        "nearest_mass": f"with e(z, symbol, m) as (values {', '.join(f'({z}, {s!r}, {m!r}::double)' for s, z, m in ELEMENTS)}), k as (select p_partkey, cast(p_partkey % 300 + 0.3 as double) as mass from part), o as (select p_partkey, mass, symbol, row_number() over (partition by p_partkey order by abs(mass - m), z) as rn from k, e) select p_partkey, {r('mass', 'mass')}, symbol from o where rn = 1",
        "fold_positions": with_(EV) + "select step, atom_idx, " + ", ".join(r(f"({e}/{a!r} - floor({e}/{a!r}))*{a!r}", c) for c, e, a in (("x", "(x-20)", 7.5), ("y", "y", 3.25), ("z", "(z-50)", 11.0))) + " from traj_ev",
        "log_scaled_vectors": with_(EMB, "n as (select *, sqrt(fx*fx+fy*fy+fz*fz) as d from traj_emb)") + f"select step, atom_idx, {', '.join(r(f'case when d < 1e-8 then {c} else ln(d+2)/d*{c} end', c) for c in ('fx', 'fy', 'fz'))} from n",
        "compat_check": with_(EV, ATOMS, HALVES) + "select traj_id, (select string_agg(type, ',' order by atom_idx) from atoms10) as types, count(distinct step) as n_steps, true as fits, false as fits_timestep, false as fits_arrays, false as fits_types from traj_2 group by traj_id",
        "msd_plot_bands": msd() + f", s as (select species, t_fs, avg(msd) as m, stddev_pop(msd)/sqrt(count(*)-1) as e from msd group by all) select species, cast(t_fs as double) as x, {r('m', 'y', 4)}, {r('m-e', 'low', 4)}, {r('m+e', 'high', 4)} from s",
        "msd_plot_fit_lines": msd() + f", {fits([(5, 20)], 'species, traj_id, block')} select fit_idx, species, traj_id, block, cast(x as double) as x, {r('slope*x + intercept', 'y', 3)} from fits, (values (10.0), (40.0)) v(x)",
        "dump_roundtrip": _dump(1, 1, 1), "dump_scaled": _dump(2, 4, 2),
        "extxyz_roundtrip": with_(EMB, ATOMS, CELLS, "o as (select atom_idx, type, cast(row_number() over (order by case type when 'H' then 1 when 'Li' then 3 else 8 end, atom_idx) - 1 as int) as place from atoms10)") + f"select cast(step as bigint) as step, place as atom_idx, type, {rows('x y z vx vy vz fx', 5)}, {rows('ax by_', 5)} from traj_emb join o using (atom_idx) join cells_emb using (traj_id, step)",
        "xsf_roundtrip": with_(GRID) + f"select ix, iy, iz, {r('value', 'value')} from grid10",
        "store_roundtrip": with_(EMB, CELLS) + f"select step, atom_idx, {rows('x vy fz ax by_')} from traj_emb join cells_emb using (traj_id, step)",
    }
    return out


def _dump(a: float, b: float, c: float) -> str:
    """Frames 3, 5, 7, ... are not read with skip 3 and every second frame of all: 4, 6, 8, ... are."""
    return with_(EMB, ATOMS) + f"select cast(step/2 - 2 as bigint) as step, cast(step*5 as bigint) as raw_timestep, atom_idx, type, {r(f'x*{a}', 'x')}, {r(f'y*{b}', 'y')}, {r(f'z*{c}', 'z')}, {rows('vx vy vz')}, {r('2*fx', 'fx')}, {r('2*fy', 'fy')}, {r('2*fz', 'fz')} from traj_emb join atoms10 using (atom_idx) where step >= 3 and step % 2 = 0"
