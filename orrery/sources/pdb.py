"""Structure text: fixed-column ATOM records, parsed and written by JVM string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOLVENT = ("WAT", "Cl-", "Na+")
F_TRIM = "trim(substring(s, {}, 8))"


def _atoms(models: DataFrame) -> DataFrame:
    """The atoms of (traj_id, frame, text): a model is taken apart by itself, so that no window spans a file."""
    lines = models.select("traj_id", "frame", F.posexplode(F.filter(F.split("text", "\r?\n"), lambda s: s.startswith("ATOM") | s.startswith("HETATM"))).alias("line", "s"))
    cut = lambda a, n: F.trim(F.substring("s", a, n))
    own = lines.select(
        "traj_id", "frame", "line", cut(13, 4).alias("atom_name"), cut(18, 4).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).alias("resseq"), cut(27, 1).alias("code"), cut(77, 2).alias("element"),
        *(F.expr(f"try_cast({F_TRIM.format(31 + 8 * i)} as double)").alias(a) for i, a in enumerate("xyz")),
    )
    in_frame = Window.partitionBy("traj_id", "frame").orderBy("line")
    before = F.lag(F.struct("resname", "chain", "resseq", "code")).over(in_frame)
    new = F.when(before.isNull() | ~(before.eqNullSafe(F.struct("resname", "chain", "resseq", "code"))), 1).otherwise(0)
    numbered = own.withColumn("new", new).withColumn("resid", F.sum("new").over(in_frame) - 1)
    return numbered.select("traj_id", F.col("frame").cast("int").alias("frame"), F.col("line").cast("int").alias("atom_id"), "atom_name", "resname", F.col("resid").cast("int").alias("resid"), "element", "x", "y", "z")


def parse(texts: DataFrame, id_col: str = "traj_id", text_col: str = "text") -> DataFrame:
    """(traj_id, frame, atom_id, atom_name, resname, resid, element, x, y, z) of texts with one structure each; models are frames, ids count from 0."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), "\n(?=MODEL)")
    # what stands before the first model belongs to it
    parts = F.when(F.size(parts) > 1, F.concat(F.array(F.concat_ws("\n", parts[0], parts[1])), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))).otherwise(parts)
    return _atoms(texts.select(F.col(id_col).alias("traj_id"), F.posexplode(parts).alias("frame", "text")))


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """All structure files under path; traj_id is the file's name without its ending.

    A row is read up to ENDMDL, so that a file of many models is read in splits and no model waits for another. Models are frames in order of
    their serial numbers; a file that has one number twice, or several models without one, is refused. whole reads each file as one row, in which
    models are frames as they come."""
    traj = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1)
    if whole:
        texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
        return parse(texts.select(traj.alias("traj_id"), F.col("value").alias("text")))
    rows = spark.read.option("lineSep", "ENDMDL").option("recursiveFileLookup", True).text(path)
    serial = F.coalesce(F.expr(r"try_cast(regexp_extract(value, '(?:^|\n)MODEL +([0-9]+)', 1) as long)"), F.lit(0))
    models = rows.where(F.col("value").rlike("(?:^|\n)(?:ATOM|HETATM)")).select(traj.alias("traj_id"), serial.alias("serial"), F.col("value").alias("text"))
    numbers = models.groupBy("traj_id", "serial").agg(F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("two models of one number in "), F.col("traj_id"), F.lit("; read it whole"))).cast("int")
    frames = numbers.select("traj_id", "serial", F.when(F.col("n") > 1, twice).otherwise(F.row_number().over(Window.partitionBy("traj_id").orderBy("serial")) - 1).alias("frame"))
    return _atoms(models.join(frames, ["traj_id", "serial"]).select("traj_id", "frame", "text"))


def strip_solvent(atoms: DataFrame, names: tuple[str, ...] = SOLVENT) -> DataFrame:
    return atoms.where(~F.col("resname").isin(*names))


def _name(name: Column) -> Column:
    """Four columns: names that begin with a digit or fill them stay, others leave the first free."""
    n = F.length(name)
    return F.when(name.rlike("^[0-9]"), F.rpad(name, 4, " ")).when(n == 3, F.lpad(name, 4, " ")).when(n == 2, F.concat(F.lit(" "), name, F.lit(" "))).when(n == 1, F.concat(F.lit(" "), name, F.lit("  "))).otherwise(F.rpad(name, 4, " "))


def lines(atoms: DataFrame, keys: list[str], order: str = "atom_id", mark: str = "ATOM") -> DataFrame:
    """keys, place and line of each atom."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    at = atoms.withColumn("place", place)
    number = lambda c, w: F.lpad(c.cast("string"), w, " ")
    coordinate = lambda c: F.lpad(F.format_string("%.3f", F.round(F.col(c).cast("double"), 3)), 8, " ")
    line = F.concat(F.rpad(F.lit(mark), 6, " "), number(F.col("place") % 99999 + 1, 5), F.lit(" "), F.rpad(_name(F.col("atom_name")), 4, " "), F.lit(" "), F.lpad(F.col("resname"), 3, " "), F.lit("  "), number((F.col("resid") + 1) % 10000, 4), F.lit("    "), coordinate("x"), coordinate("y"), coordinate("z"), F.lit("  1.00  0.00"))
    for upper in ("CL", "BR", "NA", "MG", "ZN", "FE", "CU", "NI", "MN"):
        line = F.replace(line, F.lit(upper), F.lit(upper.capitalize()))
    return at.select(*keys, "place", line.alias("line"))


def block(atoms: DataFrame, keys: list[str], order: str = "atom_id", mark: str = "ATOM") -> DataFrame:
    """keys and text: a structure's records in order, closed by TER."""
    rows = lines(atoms, keys, order, mark).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    return rows.select(*keys, F.concat(F.array_join("l.line", "\n"), F.lit("\nTER\n")).alias("text"))


def write(texts: DataFrame, path: str, id_col: str = "traj_id", text_col: str = "text") -> None:
    """A folder of text for each structure; read() with the folder's name as the id is up to the caller."""
    texts.select(id_col, text_col).repartition(id_col).write.mode("overwrite").partitionBy(id_col).text(path)


def combine(ligands: DataFrame, proteins: DataFrame, key: str = "traj_id") -> DataFrame:
    """key and text: the atom records of both texts, the protein's first, with UNL renamed to LIG."""
    records = lambda c: F.filter(F.split(c, "\r?\n"), lambda s: s.rlike("^(ATOM|HETATM)"))
    both = proteins.select(key, F.col("text").alias("p")).join(ligands.select(key, F.replace("text", F.lit("UNL"), F.lit("LIG")).alias("l")), key)
    return both.select(key, F.array_join(F.concat(records(F.col("p")), records(F.col("l")), F.array(F.lit("END"))), "\n").alias("text"))


def with_dummies(atoms: DataFrame, points: DataFrame, name: str = "BOX") -> DataFrame:
    """atoms with the points (traj_id, x, y, z, place) appended as pseudo-atoms of one more residue."""
    last = atoms.groupBy("traj_id").agg(F.max("atom_id").alias("a"), F.max("resid").alias("r"))
    extra = points.join(last, "traj_id").select("traj_id", (F.col("a") + 1 + F.col("place")).alias("atom_id"), (F.col("r") + 1).alias("resid"), F.lit(name).alias("resname"), F.lit("X").alias("atom_name"), "x", "y", "z")
    return atoms.select(*extra.columns).unionByName(extra)


def title(text: Column) -> Column:
    """The TITLE records' text."""
    own = F.filter(F.split(text, "\r?\n"), lambda s: s.startswith("TITLE"))
    return F.array_join(F.transform(own, lambda s: F.trim(F.substring(s, 11, 70))), " ")


def sequence(text: Column, chain: str) -> Column:
    """Three-letter residues of the chain's SEQRES records."""
    own = F.filter(F.split(text, "\r?\n"), lambda s: s.startswith("SEQRES") & (F.substring(s, 12, 1) == chain))
    return F.filter(F.split(F.array_join(F.transform(own, lambda s: F.trim(F.substring(s, 20, 52))), " "), " +"), lambda s: s != "")


def molecules(texts: DataFrame, id_col: str = "file", text_col: str = "text") -> DataFrame:
    """(file, position, text) of each molecule of multi-molecule mol2 (split at its header) or sdf texts (at $$$$)."""
    parts = F.when(F.col(text_col).contains("@<TRIPOS>MOLECULE"), F.transform(F.filter(F.split(text_col, "@<TRIPOS>MOLECULE"), lambda s: F.trim(s) != ""), lambda s: F.concat(F.lit("@<TRIPOS>MOLECULE"), s)))
    parts = parts.otherwise(F.filter(F.split(text_col, r"\$\$\$\$\r?\n?"), lambda s: F.trim(s) != ""))
    return texts.select(F.col(id_col).alias("file"), F.posexplode(parts).alias("position", "text"))
