"""Physical constants, units and the element table."""

from __future__ import annotations

# CODATA 2014 constants; results depend on them to the last digit.
K_BOLTZMANN = 1.38064852e-23
K_BOLTZMANN_EV = 8.6173303e-5
K_BOLTZMANN_HARTREE = 3.166810800209422e-06
AMU_KG = 1.660539040e-27
BOHR_IN_ANGSTROM = 0.52917721092
#: Fixed value: density grid files use this older figure.
XSF_BOHR_IN_ANGSTROM = 0.52917720859

#: Temperature in K of 1 amu (Angstrom/fs)^2 per degree of freedom.
KINETIC_FACTOR = AMU_KG * 1e10 / K_BOLTZMANN
#: Angstrom^2/fs to cm^2/s.
DIFFUSION_CM2_S = 0.1

# Published standard atomic weights (conventional, or mass number of the longest-lived isotope), by atomic number.
_SYMBOLS = """H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru
Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th
Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"""
_WEIGHTS = """1.008 4.002602 6.94 9.0121831 10.81 12.011 14.007 15.999 18.998403163 20.1797 22.98976928 24.305 26.9815385 28.085 30.973761998
32.06 35.45 39.948 39.0983 40.078 44.955908 47.867 50.9415 51.9961 54.938044 55.845 58.933194 58.6934 63.546 65.38 69.723 72.630 74.921595
78.971 79.904 83.798 85.4678 87.62 88.90584 91.224 92.90637 95.95 97.90721 101.07 102.90550 106.42 107.8682 112.414 114.818 118.710 121.760
127.60 126.90447 131.293 132.90545196 137.327 138.90547 140.116 140.90766 144.242 144.91276 150.36 151.964 157.25 158.92535 162.500 164.93033
167.259 168.93422 173.054 174.9668 178.49 180.94788 183.84 186.207 190.23 192.217 195.084 196.966569 200.592 204.38 207.2 208.98040 208.98243
209.98715 222.01758 223.01974 226.02541 227.02775 232.0377 231.03588 238.02891 237.04817 244.06421 243.06138 247.07035 247.07031 251.07959
252.0830 257.09511 258.09843 259.1010 262.110 267.122 268.126 271.134 270.133 269.1338 278.156 281.165 281.166 285.177 286.182 289.190 289.194
293.204 293.208 294.214"""
#: (symbol, atomic number, mass) by atomic number.
ELEMENTS = [(s, z, float(m)) for z, (s, m) in enumerate(zip(_SYMBOLS.split(), _WEIGHTS.split(), strict=True), 1)]
MASSES = {s: m for s, _, m in ELEMENTS}
NUMBERS = {s: z for s, z, _ in ELEMENTS}

# The few colours (red, green, blue of 255) that plots of common systems ask for.
COLOURS = {
    "jmol": {"H": (0, 0, 0), "Li": (204, 128, 255), "C": (144, 144, 144), "N": (48, 80, 248), "O": (255, 13, 13), "F": (144, 224, 80), "Na": (171, 92, 242), "Al": (191, 166, 166), "Si": (240, 200, 160), "P": (255, 128, 0), "S": (255, 255, 48), "Cl": (31, 240, 31)},
    "cpk": {"H": (0, 0, 0), "Li": (178, 33, 33), "C": (199, 199, 199), "N": (143, 143, 255), "O": (240, 0, 0), "F": (218, 165, 32), "Na": (0, 0, 255), "Al": (128, 128, 144), "Si": (218, 165, 32), "P": (255, 165, 0), "S": (255, 199, 49), "Cl": (0, 255, 0)},
}


def colour(symbol: str, scheme: str = "jmol") -> tuple[float, float, float] | None:
    """Red, green and blue (0 to 1) of an element; None for unknown symbols; hydrogen is black in any scheme."""
    if scheme not in COLOURS:
        raise ValueError(f"unknown scheme {scheme!r}")
    found = COLOURS[scheme].get(symbol)
    return None if found is None else tuple(c / 255 for c in found)
