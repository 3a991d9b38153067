"""Queries of scans, masks, crops, slices, foci, properties, labels, residues and contacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.constants import BACKBONE, RESIDUES
from ..functions.masks import select_atoms
from ..operators import grid as g
from ..operators import labels, residues, windows
from ..sources import pdb
from ..sources.loader import Loader
from ..spec import GridSpec
from .featurizer import WEIGHTS
from .registry import add, query

POINT = "traj_id:i frame:i atom_id:i"
XYZ = "x:d y:d z:d"
_D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"

# sources


@query(f"{POINT} resid:i resname:s atom_name:s {XYZ}", "SELECT traj_id, frame, atom_id, resid, resname, atom_name, x, y, z FROM v_points WHERE frame = 0")
def scan_atoms(v):
    """Structures written as text, and read from it."""
    return pdb.parse(pdb.block(v.points.where("frame = 0"), ["traj_id"]).withColumn("text", F.replace("text", F.lit("Na"), F.lit("NA"))))


@query("traj_id:i place:i line:s", """
SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY atom_id) - 1 AS place,
    'ATOM  ' || lpad(CAST((row_number() OVER (PARTITION BY traj_id ORDER BY atom_id) - 1) % 99999 + 1 AS VARCHAR), 5, ' ') || ' ' ||
    CASE length(atom_name) WHEN 1 THEN ' ' || atom_name || '  ' WHEN 2 THEN ' ' || atom_name || ' ' ELSE lpad(atom_name, 4, ' ') END || ' ' || resname || '  ' || lpad(CAST(resid + 1 AS VARCHAR), 4, ' ') || '    ' ||
    lpad(printf('%.3f', x::DOUBLE), 8, ' ') || lpad(printf('%.3f', y::DOUBLE), 8, ' ') || lpad(printf('%.3f', z::DOUBLE), 8, ' ') || '  1.00  0.00' AS line
FROM v_points WHERE frame = 3""")
def pdb_lines(v):
    return pdb.lines(v.points.where("frame = 3"), ["traj_id"])


@query("traj_id:i n_lines:i digest:s", """
l AS (SELECT traj_id, atom_id, 'ATOM  ' || lpad(CAST(row_number() OVER (PARTITION BY traj_id ORDER BY atom_id) AS VARCHAR), 5, ' ') || ' ' ||
    rpad(CASE length(atom_name) WHEN 1 THEN ' ' || atom_name || '  ' WHEN 2 THEN ' ' || atom_name || ' ' ELSE lpad(atom_name, 4, ' ') END, 4, ' ') || ' ' || resname || '  ' || lpad(CAST(resid + 1 AS VARCHAR), 4, ' ') || '    ' ||
    lpad(printf('%.3f', x::DOUBLE), 8, ' ') || lpad(printf('%.3f', y::DOUBLE), 8, ' ') || lpad(printf('%.3f', z::DOUBLE), 8, ' ') || '  1.00  0.00' AS line FROM v_points WHERE frame = 0)
--
SELECT traj_id, count(*) + 1 AS n_lines, md5(string_agg(line, chr(10) ORDER BY atom_id) || chr(10) || 'TER' || chr(10)) AS digest FROM l GROUP BY ALL""")
def pdb_block(v):
    text = pdb.block(v.points.where("frame = 0"), ["traj_id"])
    return text.select("traj_id", (F.size(F.split("text", "\n")) - 1).alias("n_lines"), F.md5("text").alias("digest"))


@query("traj_id:i n:i digest:s", """
SELECT traj_id, count(*) AS n, 'ATOM' AS digest FROM v_atoms WHERE atom_id % 3 < 2 GROUP BY ALL""")
def combine_structures(v):
    """Two structures' records in one text: proteins' first, then the ligands'."""
    one = v.points.where("frame = 0")
    both = pdb.combine(pdb.block(one.where("atom_id % 3 = 1"), ["traj_id"], mark="HETATM"), pdb.block(one.where("atom_id % 3 = 0"), ["traj_id"]))
    lines = F.split("text", "\n")
    return both.select("traj_id", (F.size(lines) - 1).alias("n"), F.substring(F.element_at(lines, 1), 1, 4).alias("digest"))


@query("traj_id:i atom_id:i resname:s", "SELECT traj_id, atom_id, resname FROM v_atoms WHERE resname NOT IN ('ALA', 'GLY')")
def scan_strip_solvent(v):
    return pdb.strip_solvent(v.atoms, ("ALA", "GLY"))


@query(f"{POINT} {XYZ}", "SELECT traj_id, frame // 4 AS frame, atom_id, x, y, z FROM v_coords WHERE frame % 4 = 0")
def frame_stride(v):
    return windows.stride(v.coords, 4)


@query(f"{POINT} {XYZ}", "SELECT traj_id, CASE frame WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS frame, atom_id, x, y, z FROM v_coords WHERE frame IN (7, 2, 20)")
def frame_subset(v):
    return windows.frame_subset(v.coords, [7, 2, 20])


def _loader(v) -> Loader:
    return Loader.of_ids(v.atoms.select("traj_id").distinct().where("traj_id < 3"), v.coords, v.atoms, 5)


@query(f"position:i {POINT} {XYZ}", "SELECT traj_id AS position, traj_id, frame // 5 AS frame, atom_id, x, y, z FROM v_coords WHERE traj_id IN (0, 2) AND frame % 5 = 0")
def loader_slice(v):
    return _loader(v)[::2].frames()


@query("position:i traj_id:i n:i", "SELECT traj_id AS position, traj_id, count(DISTINCT frame) AS n FROM v_coords WHERE traj_id >= 3 OR frame % 5 = 0 GROUP BY ALL")
def loader_append(v):
    more = v.atoms.select("traj_id").distinct().where("traj_id >= 3")
    return _loader(v).append(more).frames().groupBy("position", "traj_id").agg(F.count_distinct("frame").alias("n"))


@query(f"{POINT}", "SELECT traj_id, frame, atom_id FROM v_coords SEMI JOIN (SELECT r_regionkey AS traj_id FROM region WHERE r_name < 'B') AS r USING (traj_id)")
def loader_semi_join(v):
    ids = v.table("region").where("r_name < 'B'").select(F.col("r_regionkey").cast("long").alias("traj_id"))
    return v.coords.join(ids, "traj_id", "left_semi")


@query("traj_id:i atom_id:i resid:i resname:s atom_name:s", """
SELECT traj_id, atom_id, resid, resname, atom_name FROM v_atoms
UNION ALL SELECT traj_id, max(atom_id) + 1 + d.p, max(resid) + 1, 'BOX', 'X' FROM v_atoms, (SELECT unnest(range(4)) AS p) d GROUP BY traj_id, d.p""")
def add_dummy_points(v):
    first = v.points.where("frame = 0")
    box = first.select("traj_id").distinct().select("traj_id", F.inline(F.expr("transform(sequence(0, 3), p -> named_struct('place', p, 'x', double(p), 'y', 0D, 'z', 0D))")))
    return pdb.with_dummies(first, box)


# masks and crops

for _name, _mask, _where in (
    ("mask_residue", ":ARG,ASP,1-2", "resname IN ('ARG', 'ASP') OR resid < 2"),
    ("mask_atom", "@CA,H=,1-3 | @O?", "atom_name = 'CA' OR atom_name LIKE 'H%' OR atom_id < 3 OR atom_name LIKE 'O_'"),
    ("mask_not", "!(:ALA,GLY & @C=) & !@N", "NOT (resname IN ('ALA', 'GLY') AND atom_name LIKE 'C%') AND atom_name <> 'N'"),
    ("mask_precedence", "@N | :GLY & @CA", "atom_name = 'N' OR resname = 'GLY' AND atom_name = 'CA'"),
):
    add(_name, "traj_id:i atom_id:i", lambda v, m=_mask: select_atoms(v.atoms, m), f"SELECT traj_id, atom_id FROM v_atoms WHERE {_where}")


@query("traj_id:i atom_id:i", f"""
p AS (SELECT * FROM v_points WHERE frame = 0), near AS (SELECT DISTINCT a.traj_id, a.resid FROM p a JOIN p b USING (traj_id) WHERE b.resname = 'ARG' AND b.atom_name = 'CA' AND {_D2} < 4)
--
SELECT traj_id, atom_id FROM p JOIN near USING (traj_id, resid) WHERE resname <> 'ASP'""")
def mask_within(v):
    return select_atoms(v.points.where("frame = 0"), ":ARG@CA<:2 & !:ASP")


@query("traj_id:i atom_id:i", f"""
p AS (SELECT * FROM v_points WHERE frame = 0), near AS (SELECT DISTINCT a.traj_id, a.atom_id FROM p a JOIN p b USING (traj_id) WHERE b.resname = 'GLY' AND {_D2} < 1)
--
SELECT traj_id, atom_id FROM p ANTI JOIN near USING (traj_id, atom_id)""")
def mask_beyond(v):
    return select_atoms(v.points.where("frame = 0"), ":GLY>@1")


@query("traj_id:i atom_id:i", "SELECT traj_id, atom_id FROM v_atoms WHERE atom_id IN (1, 5, 8, 99)")
def select_index(v):
    return v.atoms.where(F.col("atom_id").isin(1, 5, 8, 99))


_GRID = GridSpec(4, 1.0)
_IN = " AND ".join(f"{a} > -1.5 AND {a} < 4.5" for a in "xyz")


def _moved(v):
    rows = v.points.withColumns({f"f{a}": F.lit(4.0) for a in "xyz"})
    return g.translate(rows, _GRID)


_MOVED = "m AS (SELECT traj_id, frame, atom_id, resid, atom_name, x - 4 + 2 - 0.5 AS x, y - 4 + 2 - 0.5 AS y, z - 4 + 2 - 0.5 AS z FROM v_points)"


@query(f"{POINT} {XYZ}", _MOVED + "\n--\nSELECT * FROM m")
def translate_focus(v):
    return _moved(v)


@query(f"{POINT} {XYZ}", _MOVED + f"\n--\nSELECT * FROM m WHERE {_IN}")
def crop_box(v):
    return g.crop(_moved(v), _GRID, 1.0)


@query(f"{POINT} {XYZ}", _MOVED + f", r AS (SELECT DISTINCT traj_id, frame, resid FROM m WHERE {_IN})\n--\nSELECT m.* FROM m JOIN r USING (traj_id, frame, resid)")
def crop_by_residue(v):
    return g.crop(_moved(v), _GRID, 1.0, by_residue=True)


@query(f"{POINT} {XYZ}", _MOVED + f", r AS (SELECT DISTINCT traj_id, frame, resid FROM m WHERE {_IN})\n--\nSELECT m.* FROM m JOIN r USING (traj_id, frame, resid) WHERE atom_name = 'CA'")
def crop_then_select(v):
    return select_atoms(g.crop(_moved(v), _GRID, 1.0, by_residue=True), "@CA")


@query(f"{POINT} {XYZ}", "SELECT traj_id, frame, atom_id, x, y, z FROM v_coords WHERE x > 2 AND x < 5 AND y > 2 AND y < 6 AND z > 3.5 AND z < 4.5")
def box_filter(v):
    return g.box_filter(v.coords, (3.5, 4.0, 4.0), (3.0, 4.0, 1.0))


@query("traj_id:i mask:s", "SELECT traj_id, ':' || string_agg(CAST(resid + 1 AS VARCHAR), ',' ORDER BY resid + 1) AS mask FROM (SELECT DISTINCT traj_id, resid FROM v_atoms WHERE atom_name IN ('CA', 'N')) q GROUP BY ALL")
def protein_mask(v):
    return residues.residue_mask(v.atoms)


# slices and foci


@query(f"{POINT} slice_id:i slice_frame:i", "SELECT traj_id, frame, atom_id, frame // 4 AS slice_id, frame % 4 AS slice_frame FROM v_coords WHERE frame < 20")
def slice_tumbling(v):
    return windows.slices(v.coords, 4)


@query("traj_id:i place:i slice_id:i v:d", "n AS (SELECT *, count(*) OVER (PARTITION BY traj_id) AS n FROM v_series)\n--\nSELECT traj_id, frame AS place, frame // 8 AS slice_id, v FROM n WHERE frame // 8 < n // 8")
def slice_series(v):
    return windows.tumbling(v.series, ["traj_id"], ["frame"], 8)


_FOCUS = "traj_id:i slice_id:i focus_id:i fx:d fy:d fz:d"


def _focus_sql(where: str, focus: str = "0", source: str = "v_points") -> str:
    return f"SELECT traj_id, frame // 5 AS slice_id, {focus} AS focus_id, avg(x) AS fx, avg(y) AS fy, avg(z) AS fz FROM {source} WHERE frame IN (0, 5, 10, 15) AND {where} GROUP BY ALL"


@query(_FOCUS, _focus_sql("resname = 'ARG'"))
def focus_mask(v):
    return windows.focus_of_selection(windows.slices(v.coords, 5), select_atoms(v.atoms, ":ARG"))


@query(_FOCUS, _focus_sql("atom_id IN (1, 2, 30)") + " UNION ALL " + _focus_sql("atom_id = 4", "1"))
def focus_index(v):
    return windows.focus_of_indices(windows.slices(v.coords, 5), [[1, 2, 30], 4])


@query(_FOCUS, "SELECT DISTINCT traj_id, frame // 5 AS slice_id, p.i AS focus_id, p.a AS fx, p.b AS fy, p.c AS fz FROM v_coords, (VALUES (0, 1.0, 2.0, 3.0), (1, 4.0, 4.0, 4.5)) p(i, a, b, c) WHERE frame < 20")
def focus_absolute(v):
    return windows.focus_absolute(windows.slices(v.coords, 5), [(1, 2, 3), (4, 4, 4.5)])


@query(_FOCUS, _focus_sql("(traj_id = 0 AND atom_id IN (3, 4) OR traj_id = 2 AND atom_id = 7)"))
def focus_json(v):
    """Foci from a JSON object of atom ids by trajectory; it also names one that no table has."""
    text = v.spark.createDataFrame([('{"0": [3, 4], "2": [7], "-1": [1]}',)], "j string")
    named = text.select(F.explode(F.from_json("j", "map<string, array<int>>")).alias("k", "atom_ids")).select(F.col("k").cast("long").alias("traj_id"), "atom_ids")
    return windows.focus_of_map(windows.slices(v.coords, 5), named)


# properties


#: Of the elements that the atoms have, as published (IUPAC's abridged masses, Bondi's radii, Pauling's electronegativities); not the engine's table.
_KNOWN = {
    "mass": "(1, 1.008), (6, 12.011), (7, 14.007), (8, 15.999), (16, 32.06), (15, 30.974), (9, 18.998), (17, 35.45), (35, 79.904), (53, 126.904)",
    "vdw_radius": "(1, 1.2), (6, 1.7), (7, 1.55), (8, 1.52), (16, 1.8), (15, 1.8), (9, 1.47), (17, 1.75), (35, 1.85), (53, 1.98)",
    "electronegativity": "(1, 2.20), (6, 2.55), (7, 3.04), (8, 3.44), (16, 2.58), (15, 2.19), (9, 3.98), (17, 3.16), (35, 2.96), (53, 2.66)",
}


def _property(field: str) -> str:
    return f"SELECT traj_id, atom_id, p.w AS w FROM v_atoms JOIN (VALUES {_KNOWN[field]}) p(z, w) ON z_number = p.z"


_SPINE = ", ".join(f"'{b}'" for b in BACKBONE)
for _name, _weight, _options, _sql_ in (
    ("prop_atomic_number", "atomic_number", {}, "SELECT traj_id, atom_id, z_number AS w FROM v_atoms"),
    ("prop_mass", "mass", {}, _property("mass")),
    ("prop_heavy", "heavy", {"value": 2.0}, "SELECT traj_id, atom_id, CASE WHEN z_number > 1 THEN 2 ELSE 0 END AS w FROM v_atoms"),
    ("prop_radius", "radius", {}, _property("vdw_radius")),
    ("prop_electronegativity", "electronegativity", {}, _property("electronegativity")),
    ("prop_hydrophobicity", "hydrophobicity", {}, _property("electronegativity").replace("p.w AS w", "abs(p.w - 2.55) AS w")),
    ("prop_backbone", "backbone", {}, f"SELECT traj_id, atom_id, CASE WHEN atom_name IN ({_SPINE}) THEN 1 ELSE 0 END AS w FROM v_atoms"),
    ("prop_sidechain", "sidechain", {}, f"SELECT traj_id, atom_id, CASE WHEN atom_name IN ({_SPINE}) THEN 0 ELSE 1 END AS w FROM v_atoms"),
    ("prop_atom_type", "atom_type", {"element": 7}, "SELECT traj_id, atom_id, CASE WHEN z_number = 7 THEN 1 ELSE 0 END AS w FROM v_atoms"),
    ("prop_selection", "selection", {"mask": "@CA", "value": 3.0}, "SELECT traj_id, atom_id, CASE WHEN atom_name = 'CA' THEN 3 ELSE 0 END AS w FROM v_atoms"),
    ("prop_uniform", "uniform", {"value": 1.5}, "SELECT traj_id, atom_id, 1.5 AS w FROM v_atoms"),
    ("prop_manual_charge", "manual_charge", {"charges": ((0, 0.5), (7, -1.0))}, "SELECT traj_id, atom_id, CASE atom_id WHEN 0 THEN 0.5 WHEN 7 THEN -1 ELSE 0 END AS w FROM v_atoms"),
):
    add(_name, "traj_id:i atom_id:i w:d", lambda v, w=_weight, o=_options: v.atoms.withColumn("w", WEIGHTS[w](**o)), _sql_)


@query("traj_id:i atom_id:i resid:i", "SELECT traj_id, atom_id, resid FROM v_atoms")
def prop_ids(v):
    return v.atoms.select("traj_id", WEIGHTS["atom_id"]().alias("atom_id"), WEIGHTS["residue_id"]().alias("resid"))


@query("traj_id:i atom_id:i positive:d negative:d signed:d", "SELECT traj_id, atom_id, greatest(charge, 0) AS positive, least(charge, 0) AS negative, charge AS signed FROM v_atoms")
def charge_sign(v):
    return v.atoms.select("traj_id", "atom_id", *(WEIGHTS["charge"](k).alias(n) for k, n in (("positive", "positive"), ("negative", "negative"), ("both", "signed"))))


@query("z:i symbol:s mass:d covalent_radius:d ionization_energy:d", """
SELECT * FROM (VALUES (1, 'H', 1.008, 0.31, 1312.0), (2, 'He', 4.003, 0.28, 2372.3), (3, 'Li', 6.94, 1.28, 520.2), (4, 'Be', 9.012, 0.96, 899.5), (5, 'B', 10.81, 0.85, 800.6), (6, 'C', 12.011, 0.76, 1086.5), (7, 'N', 14.007, 0.71, 1402.3),
    (8, 'O', 15.999, 0.66, 1313.9), (9, 'F', 18.998, 0.57, 1681.0), (10, 'Ne', 20.18, 0.58, 2080.7), (11, 'Na', 22.99, 1.66, 495.8), (12, 'Mg', 24.305, 1.41, 737.7), (13, 'Al', 26.982, 1.21, 577.5), (14, 'Si', 28.085, 1.11, 786.5),
    (15, 'P', 30.974, 1.07, 1011.8), (16, 'S', 32.06, 1.05, 999.6), (17, 'Cl', 35.45, 1.02, 1251.2), (18, 'Ar', 39.948, 1.06, 1520.6), (19, 'K', 39.098, 2.03, 418.8), (20, 'Ca', 40.078, 1.76, 589.8), (26, 'Fe', 55.845, 1.32, 762.5), (29, 'Cu', 63.546, 1.32, 745.5),
    (30, 'Zn', 65.38, 1.22, 906.4), (34, 'Se', 78.971, 1.20, 941.0), (35, 'Br', 79.904, 1.20, 1139.9), (47, 'Ag', 107.868, 1.45, 731.0), (53, 'I', 126.904, 1.39, 1008.4), (79, 'Au', 196.967, 1.36, 890.1), (80, 'Hg', 200.592, 1.32, 1007.1), (82, 'Pb', 207.2, 1.46, 715.6)) t(z, symbol, mass, covalent_radius, ionization_energy)""")
def prop_table(v):
    """The elements that structures are made of, against published values."""
    from ..functions.constants import elements

    return elements(v.spark).where("z <= 20 or z in (26, 29, 30, 34, 35, 47, 53, 79, 80, 82)")


_GIVEN = "given AS (SELECT traj_id, atom_id, atom_id % 3 = 0 AS aromatic, resid % 4 = 1 AS ring, z_number IN (7, 8) AS donor, z_number IN (8, 9) AS acceptor, CASE WHEN z_number = 6 THEN atom_id % 3 + 1 ELSE 0 END AS hybridization FROM v_atoms)"


def _given(v):
    """atoms with the perceived properties as columns."""
    z, i = F.col("z_number"), F.col("atom_id")
    return v.atoms.withColumns({"aromatic": i % 3 == 0, "ring": F.col("resid") % 4 == 1, "donor": z.isin(7, 8), "acceptor": z.isin(8, 9), "hybridization": F.when(z == 6, i % 3 + 1).otherwise(0)})


for _name, _weight, _options, _value in (
    ("prop_aromaticity", "aromatic", {}, "CAST(aromatic AS DOUBLE)"),
    ("prop_not_aromatic", "aromatic", {"reverse": True}, "1 - CAST(aromatic AS DOUBLE)"),
    ("prop_ring", "ring", {}, "CAST(ring AS DOUBLE)"),
    ("prop_donor", "donor", {}, "CAST(donor AS DOUBLE)"),
    ("prop_acceptor", "acceptor", {}, "CAST(acceptor AS DOUBLE)"),
    ("prop_hybridization", "hybridization", {}, "hybridization"),
):
    add(_name, "traj_id:i atom_id:i w:d", lambda v, w=_weight, o=_options: _given(v).withColumn("w", WEIGHTS[w](**o)), f"{_GIVEN}\n--\nSELECT traj_id, atom_id, {_value} AS w FROM given")


# files


def _trajectory_file(kind: str):
    def make(v):
        """Coordinates written as files and read from there, every other frame."""
        from ..shared import new_path
        from ..sources import trajectories

        path = new_path(v.spark)
        trajectories.write(v.coords, path, kind)
        return trajectories.read(v.spark, path, 2)

    return make


for _kind in ("dcd", "netcdf"):
    add(f"scan_{_kind}", "traj_id:i frame:i atom_id:i x:d y:d z:d", _trajectory_file(_kind), "SELECT traj_id, frame // 2 AS frame, atom_id, x, y, z FROM v_coords WHERE frame % 2 = 0")


@query("key:s value:d n:i", "SELECT lower('P' || p_partkey) AS key, p_retailprice AS value, 1 AS n FROM part WHERE p_partkey % 7 <> 0")
def scan_labels(v):
    """Labels through a CSV file; a seventh of the numbers is missing."""
    from ..shared import new_path
    from ..sources.tables import read_labels

    path = new_path(v.spark)
    p = v.table("part").select(F.concat(F.lit(" P"), F.col("p_partkey").cast("string")).alias("pdbcode"), "p_name", F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("pK"))
    p.write.option("header", True).csv(path)
    return read_labels(v.spark, path).groupBy("key", "value").agg(F.count("*").alias("n"))


@query("key:s n:i", "SELECT lower(p_brand) AS key, count(*) AS n FROM part GROUP BY ALL")
def scan_list(v):
    from ..shared import new_path
    from ..sources.tables import read_list

    path = new_path(v.spark)
    v.table("part").select(F.concat("p_brand", F.lit(" "))).write.text(path)
    return read_list(v.spark, path).groupBy("key").agg(F.count("*").alias("n"))


# labels


@query("traj_id:i identity:s", "SELECT DISTINCT traj_id, 't' || CAST(traj_id AS VARCHAR) AS identity FROM v_atoms")
def label_identity(v):
    return v.atoms.select("traj_id").distinct().withColumn("identity", F.concat(F.lit("t"), F.col("traj_id").cast("string")))


def _table(v):
    return v.table("part").select((F.col("p_partkey") % 1000).alias("key"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("position"))


_LABEL = """renamed AS (SELECT o_orderkey % 3 AS o, min(o_orderkey % 7 + 4) AS n FROM orders WHERE o_orderkey % 3 = 1 GROUP BY ALL),
t AS (SELECT DISTINCT traj_id, coalesce(renamed.n, traj_id) AS key FROM v_atoms LEFT JOIN renamed ON o = traj_id),
base AS (SELECT traj_id, (SELECT arg_min(p_retailprice, p_partkey) FROM part WHERE p_partkey % 1000 = t.key) AS value FROM t)"""


def _base(v):
    """Keys are below 1000, so trajectories from there on have no value, as in SQL."""
    renamed = v.table("orders").where("o_orderkey % 3 = 1").groupBy((F.col("o_orderkey") % 3).alias("old")).agg(F.min(F.col("o_orderkey") % 7 + 4).alias("new"))
    return labels.affinity(v.atoms.select("traj_id").distinct(), _table(v), renamed, strict=False).select("traj_id", "value")


@query("traj_id:i value:d", _LABEL + "\n--\nSELECT * FROM base")
def label_affinity(v):
    return _base(v)


@query("traj_id:i label:d", _LABEL + "\n--\nSELECT traj_id, least(floor((value % 11) / 2), 5) AS label FROM base")
def label_stepping(v):
    return _base(v).withColumn("value", F.col("value") % 11).select("traj_id", labels.stepping().alias("label"))


_RMSD = f"""r AS (SELECT a.traj_id, a.frame, sqrt(avg({_D2})) AS rmsd FROM v_coords a JOIN v_coords b ON a.traj_id = b.traj_id AND a.atom_id = b.atom_id AND b.frame = 0 GROUP BY ALL)"""


@query("traj_id:i frame:i rmsd:d", _RMSD + "\n--\nSELECT * FROM r")
def rmsd(v):
    return labels.rmsd(v.coords)


@query("traj_id:i slice_id:i label:d", _LABEL + ", " + _RMSD + "\n--\nSELECT traj_id, frame // 5 AS slice_id, any_value(value) * (1 - 0.1 * avg(least(rmsd, 1.5)) / 1.5) AS label FROM r JOIN base USING (traj_id) WHERE frame < 20 GROUP BY ALL")
def label_rmsd(v):
    return labels.rmsd_label(v.coords, _base(v), 5, 1.5)


_PAIRS = f"""pairs AS (SELECT a.traj_id, a.atom_id, arg_min(b.atom_id, ({_D2}) * 1000 + b.atom_id) AS partner_id FROM v_points a JOIN v_points b ON a.traj_id = b.traj_id AND a.frame = 0 AND b.frame = 0
    WHERE a.resname = 'ARG' AND b.atom_name IN ('C', 'N', 'CA', 'O', 'CB') AND b.resname <> 'ARG' GROUP BY ALL),
d AS (SELECT p.traj_id, p.atom_id, a.frame, sqrt({_D2}) AS distance FROM pairs p JOIN v_coords a ON a.traj_id = p.traj_id AND a.atom_id = p.atom_id JOIN v_coords b ON b.traj_id = p.traj_id AND b.atom_id = p.partner_id AND b.frame = a.frame)"""


def _pairs(v):
    return labels.closest_pairs(v.coords, select_atoms(v.atoms, ":ARG"), select_atoms(v.atoms, "@" + ",".join(labels.PARTNERS) + " & !:ARG"))


@query("traj_id:i atom_id:i partner_id:i", _PAIRS + "\n--\nSELECT * FROM pairs")
def pcdt_pairs(v):
    return _pairs(v)


@query("traj_id:i atom_id:i frame:i distance:d", _PAIRS + "\n--\nSELECT * FROM d")
def pcdt_series(v):
    return labels.distance_series(v.coords, _pairs(v))


@query("traj_id:i slice_id:i label:d", _LABEL + ", " + _PAIRS + """, c AS (SELECT traj_id, atom_id, frame, least(distance, 2.5) AS distance FROM d),
w AS (SELECT traj_id, atom_id, avg(distance) AS m0, CASE WHEN stddev_pop(distance) = 0 THEN 2.5 ELSE stddev_pop(distance) END AS s0 FROM c GROUP BY ALL),
s AS (SELECT traj_id, atom_id, frame // 7 AS slice_id, avg(distance) AS m1 FROM c GROUP BY ALL)
--
SELECT traj_id, slice_id, any_value(value) * (1 - 0.1 * abs(avg((m0 - m1) / s0))) AS label FROM s JOIN w USING (traj_id, atom_id) JOIN base USING (traj_id) GROUP BY ALL""")
def label_pcdt(v):
    return labels.pcdt_label(labels.distance_series(v.coords, _pairs(v)), _base(v), 7, 2.5)


@query("event_id:i penalty:d", "SELECT event_id, (0.95 - value / 700) * 7.5 * 0.1 AS penalty FROM events")
def penalties(v):
    return v.table("events").select("event_id", scalar.penalty(F.col("value") / 700, F.lit(7.5)).alias("penalty"))


_CODES = "(VALUES " + ", ".join(f"('{r}', {i})" for i, r in enumerate(RESIDUES)) + ")"


@query("traj_id:i resid:i single:i pair:i", f"""
r AS (SELECT DISTINCT traj_id, resid, CASE WHEN resid = 8 THEN 'HIE' ELSE resname END AS resname, lead(CASE WHEN resid = 8 THEN 'HIP' ELSE resname END) OVER (PARTITION BY traj_id ORDER BY resid) AS after FROM (SELECT DISTINCT traj_id, resid, resname FROM v_atoms) q)
--
SELECT traj_id, resid, a.c AS single, 20 * a.c + b.c AS pair FROM r LEFT JOIN {_CODES} a(n, c) ON a.n = replace(r.resname, 'HIE', 'HIS') LEFT JOIN {_CODES} b(n, c) ON b.n = CASE WHEN after IN ('HIP') THEN 'HIS' ELSE after END""")
def residue_label(v):
    one = v.atoms.select("traj_id", "resid", "resname").distinct()
    after = F.lead(F.when(F.col("resid") == 8, "HIP").otherwise(F.col("resname"))).over(Window.partitionBy("traj_id").orderBy("resid"))
    named = one.withColumn("after", after).withColumn("resname", F.when(F.col("resid") == 8, "HIE").otherwise(F.col("resname")))
    return named.select("traj_id", "resid", labels.residue_label("resname").alias("single"), labels.residue_label("resname", "after").alias("pair"))


@query("code:s plain:s", "c AS (SELECT unnest(['4DGO', ' 4otw', '1abc', '5V8J ']) AS code)\n--\nSELECT code, coalesce(CASE lower(trim(code)) WHEN '4dgo' THEN '6qs5' WHEN '4otw' THEN '6op9' WHEN '5v8j' THEN '6nfo' END, lower(trim(code))) AS plain FROM c")
def pdbcode_normalize(v):
    codes = v.spark.createDataFrame([(c,) for c in ("4DGO", " 4otw", "1abc", "5V8J ")], "code string")
    return codes.withColumn("plain", scalar.structure_code(F.col("code")))


# residues and contacts

_BLOCKS = "SELECT traj_id, resid, resname, min(atom_id) AS first_atom, max(atom_id) + 1 AS end_atom, count(*) AS n_atoms FROM v_atoms {} GROUP BY ALL"
_BLOCK = "traj_id:i resid:i resname:s first_atom:i end_atom:i n_atoms:i"


@query(_BLOCK, _BLOCKS.format("WHERE resname = 'CYS'"))
def residue_blocks(v):
    return residues.blocks(v.atoms, "CYS")


@query("traj_id:i atom_name:s atom_id:i", "SELECT traj_id, atom_name, atom_id FROM v_atoms QUALIFY row_number() OVER (PARTITION BY traj_id, atom_name ORDER BY atom_id) <= 3")
def residue_topk(v):
    """The first three blocks of each name; here atoms stand for residues."""
    own = v.atoms.select("traj_id", F.col("atom_id").alias("resid"), "atom_id", F.col("atom_name").alias("resname"))
    return residues.blocks(own, most=3).select("traj_id", F.col("resname").alias("atom_name"), F.col("first_atom").alias("atom_id"))


@query("traj_id:i resid:i next_resid:i bond:d", f"""
p AS (SELECT * FROM v_points WHERE frame = 0), one AS (SELECT traj_id, resid, atom_name FROM p WHERE atom_name IN ('C', 'N') GROUP BY ALL HAVING count(*) = 1), q AS (SELECT p.* FROM p JOIN one USING (traj_id, resid, atom_name))
--
SELECT a.traj_id, a.resid, b.resid AS next_resid, sqrt({_D2}) AS bond FROM q a JOIN q b ON a.traj_id = b.traj_id AND b.resid = a.resid + 1 AND a.atom_name = 'C' AND b.atom_name = 'N' WHERE sqrt({_D2}) <= 1.65""")
def residue_pairs(v):
    return residues.bonded_pairs(v.points.where("frame = 0"))


_PAIR_NAMES = [(p, q) for p in (6, 7, 8, 16) for q in (6, 7, 8, 9, 15, 16, 17, 35, 53)]


@query("traj_id:i " + " ".join(f"n_{p}_{q}:i" for p, q in _PAIR_NAMES), f"""
p AS (SELECT * FROM v_points WHERE frame = 0), c AS (SELECT a.traj_id, b.z_number AS p, a.z_number AS q FROM p a JOIN p b ON a.traj_id = b.traj_id WHERE a.resname IN ('ARG', 'ASP') AND b.resname NOT IN ('ARG', 'ASP') AND {_D2} <= 4)
--
SELECT t.traj_id, {", ".join(f"count(*) FILTER (p = {p} AND q = {q}) AS n_{p}_{q}" for p, q in _PAIR_NAMES)} FROM (SELECT DISTINCT traj_id FROM v_atoms) t LEFT JOIN c ON c.traj_id = t.traj_id GROUP BY ALL""")
def contact_counts(v):
    first = v.points.where("frame = 0")
    return residues.contact_counts(first, select_atoms(v.atoms, ":ARG,ASP"), 2.0, [6, 7, 8, 9, 15, 16, 17, 35, 53], [6, 7, 8, 16])


@query("traj_id:i n_atoms:i contacts:i clashes:i factor:d", f"""
p AS (SELECT v.*, r.w AS r FROM v_points v JOIN (VALUES {_KNOWN["vdw_radius"]}) r(z0, w) ON z_number = z0 WHERE frame = 0),
d AS (SELECT a.traj_id, sqrt({_D2}) AS d, a.r + b.r AS s FROM p a JOIN p b ON a.traj_id = b.traj_id AND a.atom_id <> b.atom_id WHERE abs(a.atom_id - b.atom_id) > 1),
c AS (SELECT traj_id, count(*) FILTER (d < s + 0.4) AS contacts, count(*) FILTER (d < s - 1.25) AS clashes FROM d GROUP BY ALL)
--
SELECT traj_id, n_atoms, contacts, clashes, 1 - (clashes / 2.0) / ((contacts / 2.0) / n_atoms) AS factor FROM c JOIN (SELECT traj_id, count(*) AS n_atoms FROM v_atoms GROUP BY ALL) n USING (traj_id)""")
def clash_counts(v):
    first = v.points.where("frame = 0")
    chain = v.atoms.select("traj_id", "atom_id", F.explode(F.array(F.col("atom_id") - 1, F.col("atom_id") + 1)).alias("partner_id"))
    return residues.clash_counts(first, chain).withColumn("factor", residues.conflict_factor())


@query("traj_id:i atom_id:i", "SELECT traj_id, atom_id FROM v_atoms WHERE NOT (resname = 'ARG' OR atom_id IN (4, 7))")
def atoms_anti(v):
    gone = select_atoms(v.atoms, ":ARG | @5,8").select("traj_id", "atom_id")
    return v.atoms.join(gone, ["traj_id", "atom_id"], "left_anti")


@query("traj_id:i frame:i cx:d cy:d cz:d", "SELECT traj_id, frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v_coords GROUP BY ALL")
def centroid(v):
    return v.coords.groupBy("traj_id", "frame").agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))


@query("traj_id:i frame:i cx:d cy:d cz:d", f"SELECT traj_id, frame, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy, sum(z * w) / sum(w) AS cz FROM v_points JOIN (VALUES {_KNOWN['mass']}) p(n, w) ON z_number = n GROUP BY ALL")
def center_of_mass(v):
    m = WEIGHTS["mass"]()
    return v.points.groupBy("traj_id", "frame").agg(*((F.sum(F.col(a) * m) / F.sum(m)).alias(f"c{a}") for a in "xyz"))


@query("traj_id:i frame:i atom_id:i x:d y:d z:d", None)
def superpose(v):
    from ..operators.superpose import superpose as fit

    return fit(v.coords, select_atoms(v.atoms, "@CA"))
