"""Dimension data: properties of the elements, residue classes, superseded structure codes, charges and bond lengths."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbol, mass (u), van der Waals, covalent and atomic radius (Å), Pauling electronegativity, first ionisation energy and
#: electron affinity (kJ/mol), by rising atomic number; - is unknown.
_ELEMENTS = """
H 1.008 1.2 0.31 0.53 2.2 1312 72.8
He 4.003 1.4 0.28 0.31 - 2372.3 -
Li 6.94 1.82 1.28 1.67 0.98 520.2 59.6
Be 9.012 - 0.96 1.12 1.57 899.5 -
B 10.81 - 0.85 0.87 2.04 800.6 26.7
C 12.011 1.7 0.76 0.67 2.55 1086.5 153.9
N 14.007 1.55 0.71 0.56 3.04 1402.3 7
O 15.999 1.52 0.66 0.48 3.44 1313.9 141
F 18.998 1.47 0.57 0.42 3.98 1681 328
Ne 20.18 1.54 0.58 0.38 - 2080.7 -
Na 22.99 2.27 1.66 1.9 0.93 495.8 52.8
Mg 24.305 1.73 1.41 1.45 1.31 737.7 -
Al 26.982 - 1.21 1.18 1.61 577.5 42.5
Si 28.085 2.1 1.11 1.11 1.9 786.5 133.6
P 30.974 1.8 1.07 0.98 2.19 1011.8 71
S 32.06 1.8 1.05 0.87 2.58 999.6 200
Cl 35.45 1.75 1.02 0.79 3.16 1251.2 349
Ar 39.948 1.88 1.06 0.71 - 1520.6 -
K 39.098 2.75 2.03 2.43 0.82 418.8 48.4
Ca 40.078 - 1.76 1.94 1 589.8 2.37
Sc 44.956 - 1.7 1.84 1.36 633.1 18.1
Ti 47.867 - 1.6 1.76 1.54 658.8 7.6
V 50.941 - 1.53 1.71 1.63 650.9 50.6
Cr 51.996 - 1.39 1.66 1.66 652.9 64.3
Mn 54.938 - 1.39 1.61 1.55 717.3 -
Fe 55.845 - 1.32 1.56 1.83 762.5 15.7
Co 58.933 - 1.26 1.52 1.88 760.4 63.7
Ni 58.693 1.63 1.24 1.49 1.91 737.1 112
Cu 63.546 1.4 1.32 1.45 1.9 745.5 118.4
Zn 65.38 1.39 1.22 1.42 1.65 906.4 -
Ga 69.723 1.87 1.22 1.36 1.81 578.8 28.9
Ge 72.63 - 1.2 1.25 2.01 762 119
As 74.922 1.85 1.19 1.14 2.18 947 78
Se 78.971 1.9 1.2 1.03 2.55 941 195
Br 79.904 1.85 1.2 0.94 2.96 1139.9 324.6
Kr 83.798 2.02 1.16 0.87 3 1350.8 -
Rb 85.468 - 2.2 2.65 0.82 403 46.9
Sr 87.62 - 1.95 2.19 0.95 549.5 5.03
Y 88.906 - 1.9 2.12 1.22 600 29.6
Zr 91.224 - 1.75 2.06 1.33 640.1 41.1
Nb 92.906 - 1.64 1.98 1.6 652.1 86.1
Mo 95.95 - 1.54 1.9 2.16 684.3 71.9
Tc 97 - 1.47 1.83 1.9 702 53
Ru 101.07 - 1.46 1.78 2.2 710.2 101.3
Rh 102.906 - 1.42 1.73 2.28 719.7 109.7
Pd 106.42 1.63 1.39 1.69 2.2 804.4 53.7
Ag 107.868 1.72 1.45 1.65 1.93 731 125.6
Cd 112.414 1.58 1.44 1.61 1.69 867.8 -
In 114.818 1.93 1.42 1.56 1.78 558.3 28.9
Sn 118.71 2.17 1.39 1.45 1.96 708.6 107.3
Sb 121.76 - 1.39 1.33 2.05 834 103.2
Te 127.6 2.06 1.38 1.23 2.1 869.3 190.2
I 126.904 1.98 1.39 1.15 2.66 1008.4 295.2
Xe 131.293 2.16 1.4 1.08 2.6 1170.4 -
Cs 132.905 - 2.44 2.98 0.79 375.7 45.5
Ba 137.327 - 2.15 2.53 0.89 502.9 13.95
La 138.905 - 2.07 - 1.1 538.1 48
Ce 140.116 - 2.04 - 1.12 534.4 50
Pr 140.908 - 2.03 2.47 1.13 527 50
Nd 144.242 - 2.01 2.06 1.14 533.1 50
Pm 145 - 1.99 2.05 - 540 50
Sm 150.36 - 1.98 2.38 1.17 544.5 50
Eu 151.964 - 1.98 2.31 - 547.1 50
Gd 157.25 - 1.96 2.33 1.2 593.4 50
Tb 158.925 - 1.94 2.25 - 565.8 50
Dy 162.5 - 1.92 2.28 1.22 573 50
Ho 164.93 - 1.92 2.26 1.23 581 50
Er 167.259 - 1.89 2.26 1.24 589.3 50
Tm 168.934 - 1.9 2.22 1.25 596.7 50
Yb 173.045 - 1.87 2.22 - 603.4 50
Lu 174.967 - 1.87 2.17 1.27 523.5 50
Hf 178.49 - 1.75 2.08 1.3 658.5 -
Ta 180.948 - 1.7 2 1.5 761 31
W 183.84 - 1.62 1.93 2.36 770 78.6
Re 186.207 - 1.51 1.88 1.9 760 14.5
Os 190.23 - 1.44 1.85 2.2 840 106.1
Ir 192.217 - 1.41 1.8 2.2 880 151
Pt 195.084 1.75 1.36 1.77 2.28 870 205.3
Au 196.967 1.66 1.36 1.74 2.54 890.1 222.8
Hg 200.592 1.55 1.32 1.71 2 1007.1 -
Tl 204.38 1.96 1.45 1.56 1.62 589.4 19.2
Pb 207.2 2.02 1.46 1.54 2.33 715.6 35.1
Bi 208.98 - 1.48 1.43 2.02 703 91.2
Po 209 - 1.4 1.35 2 812.1 183.3
At 210 - 1.5 1.27 2.2 920 270.1
Rn 222 - 1.5 1.2 - 1037 -
Fr 223 - 2.6 - - 380 -
Ra 226 - 2.21 - - 509.3 -
Ac 227 - 2.15 - - 499 -
Th 232.038 - 2.06 - - 587 -
Pa 231.036 - 2 - - 568 -
U 238.029 - 1.96 - - 597.6 -
Np 237 - 1.9 - - 604.5 -
Pu 244 - 1.87 - - 584.7 -
Am 243 - 1.8 - - 578 -
Cm 247 - 1.69 - - 581 -
Bk 247 - - - - 601 -
Cf 251 - - - - 608 -
Es 252 - - - - 619 -
Fm 257 - - - - 627 -
Md 258 - - - - 635 -
No 259 - - - - 642 -
Lr 262 - - - - - -
Rf 267 - - - - - -
Db 270 - - - - - -
Sg 269 - - - - - -
Bh 270 - - - - - -
Hs 270 - - - - - -
Mt 278 - - - - - -
Ds 281 - - - - - -
Rg 281 - - - - - -
Cn 285 - - - - - -
Nh 286 - - - - - -
Fl 289 - - - - - -
Mc 289 - - - - - -
Lv 293 - - - - - -
Ts 293 - - - - - -
Og 294 - - - - - -
"""
FIELDS = ("mass", "vdw_radius", "covalent_radius", "atomic_radius", "electronegativity", "ionization_energy", "electron_affinity")
ELEMENTS: dict[int, dict] = {}
for _z, _line in enumerate(_ELEMENTS.split("\n")[1:-1], 1):
    _symbol, *_values = _line.split()
    ELEMENTS[_z] = {"symbol": _symbol} | {f: None if v == "-" else float(v) for f, v in zip(FIELDS, _values)}
SYMBOLS = {v["symbol"]: z for z, v in ELEMENTS.items()}

RESIDUES = "ALA ARG ASN ASP CYS GLU GLN GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
RESIDUE_CODE = {r: i for i, r in enumerate(RESIDUES)}
#: Protonation and bridge variants.
RESIDUE_ALIAS = {"CYX": "CYS"} | dict.fromkeys("HID HIE HIP HSD HSE HSP".split(), "HIS")
PAIR_CODE = {a + b: 20 * RESIDUE_CODE[a] + RESIDUE_CODE[b] for a, b in product(RESIDUES, RESIDUES)}
SUPERSEDED = dict(p.split(">") for p in "4dgo>6qs5 4otw>6op9 4v1c>6iso 5v8h>6nfg 5v8j>6nfo 6fim>6fex 6h7k>6ibl 3m8t>5wcm 4n3l>6eo8".split())
BACKBONE = tuple("CA C HA HN N O".split())
PARTIAL_CHARGE = {k: float(v) for k, v in (p.split(":") for p in "H:.09 C:-.18 N:-.47 O:-.51 F:-.22 P:1.5 S:-.09 NA:1 K:1 MG:2 ZN:2 CA:2 CL:-.04 BR:-.1 B:.13".split())}
#: Typical bond lengths (Å) by elements and order (- single, = double, ~ aromatic, ≡ triple), either way round.
_BONDS = {k: float(v) for k, v in (p.split() for p in "C-C 1.51; C~C 1.39; C~N 1.35; C-N 1.47; C-O 1.43; C-S 1.82; N-H 1.01; C-H 1.09; O-H 0.96; C=C 1.34; C=O 1.23; C=N 1.28; C≡N 1.16; S-S 2.05".split(";"))}
BOND_LENGTH = _BONDS | {k[::-1]: v for k, v in _BONDS.items() if "~" not in k}
OTHER_BOND = 1.5


def elements(spark: SparkSession) -> DataFrame:
    """z, symbol and FIELDS: 118 rows."""
    return spark.createDataFrame([(z, v["symbol"], *(v[f] for f in FIELDS)) for z, v in ELEMENTS.items()], "z int, symbol string, " + ", ".join(f"{f} double" for f in FIELDS))


def lookup(key: Column, values: dict, default: Column | None = None) -> Column:
    """values[key] as a literal map, which Catalyst evaluates without a join; for the few rows of a dimension."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)
