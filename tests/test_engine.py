"""Masks, the featurizer, sources and sinks, streaming, dataset operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import scalar
from orrery.functions.constants import BOND_LENGTH, ELEMENTS, PAIR_CODE
from orrery.functions.masks import condition, parse, select_atoms
from orrery.operators import dataset as d
from orrery.operators import metrics, windows
from orrery.operators.grid import crop, translate, voxelize
from orrery.operators.superpose import superpose
from orrery.plans.featurizer import Featurizer, dense
from orrery.sources import pdb
from orrery.sources.loader import Loader
from orrery.sources.store import FeatureStore
from orrery.spec import FeatureSpec, GridSpec

NAMES = ["N", "CA", "C", "O", "CB", "HA", "H1", "OG1"]


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(t, i, i // 4, ["ARG", "LIG", "ALA"][i // 4 % 3], NAMES[i % 8], [7, 6, 6, 8][i % 4], 0.1 * (i % 3 - 1)) for t in range(2) for i in range(24)]
    return spark.createDataFrame(rows, "traj_id long, atom_id int, resid int, resname string, atom_name string, z_number int, charge double").cache()


@pytest.fixture(scope="module")
def coords(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f, i, *map(float, rng.uniform(0, 6, 3))) for t in range(2) for f in range(7) for i in range(24)]
    return spark.createDataFrame(rows, "traj_id long, frame int, atom_id int, x double, y double, z double").cache()


@pytest.mark.parametrize("mask, keep", [
    (":LIG", lambda i: i // 4 % 3 == 1),
    ("!:LIG,ALA", lambda i: i // 4 % 3 == 0),
    ("!(:LIG,ALA) | @CA", lambda i: i // 4 % 3 == 0 or i % 8 == 1),
    (":1-2", lambda i: i < 8),
    ("@C, @N , CA" .replace(", @N", ", N"), lambda i: i % 8 in (0, 1, 2)),
    ("@H=", lambda i: i % 8 in (5, 6)),
    ("@O*", lambda i: i % 8 in (3, 7)),
    (":*", lambda i: True),
    ("@CA | :ARG & @N", lambda i: i % 8 == 1 or i // 4 % 3 == 0 and i % 8 == 0),
    ("!@CA & :ARG", lambda i: i % 8 != 1 and i // 4 % 3 == 0),
    (":ARG@CA", lambda i: i % 8 == 1 and i // 4 % 3 == 0),
    ("@1-3,8", lambda i: i in (0, 1, 2, 7)),
])
def test_masks(atoms, mask, keep):
    got = {r.atom_id for r in select_atoms(atoms.where("traj_id = 0"), mask).collect()}
    assert got == {i for i in range(24) if keep(i)}


@pytest.mark.parametrize("mask", ["", ":", "(:LIG", ":LIG)", "& :LIG", ":LIG :ARG", "#1", ":LIG<5"])
def test_bad_masks(mask):
    with pytest.raises(ValueError):
        parse(mask)


def test_distance_masks(atoms, coords):
    first = atoms.join(coords.where("frame = 0"), ["traj_id", "atom_id"])
    pts = {(r.traj_id, r.atom_id): r for r in first.collect()}
    near = {k for k, r in pts.items() if any(q.traj_id == r.traj_id and q.resname == "LIG" and (r.x - q.x) ** 2 + (r.y - q.y) ** 2 + (r.z - q.z) ** 2 < 4 for q in pts.values())}
    res = {(t, pts[t, a].resid) for t, a in near}
    ids = lambda m: {(r.traj_id, r.atom_id) for r in select_atoms(first, m).collect()}
    assert ids(":LIG<@2") == near and ids(":LIG>@2") == set(pts) - near
    assert ids(":LIG<:2") == {k for k, r in pts.items() if (k[0], r.resid) in res}
    assert ids("!(:LIG<@2) & @CA") == {k for k, r in pts.items() if k not in near and r.atom_name == "CA"}
    with pytest.raises(ValueError):
        condition(":LIG<:2")


def test_featurizer_shares_crops_and_matches_single_steps(atoms, coords):
    grid = GridSpec(5, 1.0)
    f = Featurizer(FeatureSpec("defaults", cutoff=1.5, grid=grid), frame_width=3)
    f.register(FeatureSpec("mass", "mass", frame_offset=1), FeatureSpec("n", kernel="direct_count", frame_agg="max"), FeatureSpec("lig", "charge", "density", "mean", ":LIG", by_residue=True))
    foci = lambda s: windows.focus_of_indices(s, [[0, 1], [5]])
    out = f.run(coords, atoms, foci)
    assert {r.outkey for r in out.select("outkey").distinct().collect()} == {"mass", "n", "lig"}
    sliced = windows.slices(coords, 3)
    assert sliced.agg(F.max("frame")).first()[0] == 5
    moved = crop(translate(sliced.join(foci(sliced), ["traj_id", "slice_id"]), grid), grid, 1.5).where("slice_frame = 1")
    w = moved.join(atoms, ["traj_id", "atom_id"]).withColumn("w", scalar.element_property(F.col("z_number"), "mass"))
    keys = ["traj_id", "slice_id", "focus_id"]
    want = {tuple(r)[:-1]: r.v for r in voxelize(w, grid, 1.5, 1.0, keys).collect()}
    got = {tuple(r)[:-1]: r.v for r in out.where("outkey = 'mass'").drop("outkey").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    voxels = dense(out.where("outkey = 'n'"), grid.dims, keys).collect()
    assert all(len(r.voxels) == 125 for r in voxels)
    with pytest.raises(ValueError):
        f.register(FeatureSpec("n"))
    with pytest.raises(ValueError):
        f.register(FeatureSpec("x", "no such weight"))
    assert f.run_by_residue(coords, atoms, most=1).select("focus_id").distinct().count() == 3


def test_store(spark, tmp_path):
    s = FeatureStore(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 0, 0, 0, 0, 1.0), ("a", 0, 1, 0, 0, float("nan")), ("a", 1, 0, 0, 0, 3.0), ("b", 0, None, None, None, 7.0)], "outkey string, sample_id int, gx int, gy int, gz int, v double")
    s.append(df)
    s.append(df.where("outkey = 'b'").withColumn("sample_id", F.lit(1)))
    assert sorted(r.v for r in s.read("a").collect()) == [0, 1, 3] and s.read("b").count() == 2
    s.update("a", spark.createDataFrame([(0, 0, 0, 0, 5.0), (2, 0, 0, 0, 9.0)], "sample_id int, gx int, gy int, gz int, v double"))
    assert sorted(r.v for r in s.read("a").collect()) == [0, 3, 5, 9] and s.read("b").count() == 2
    assert sorted(r.v for r in s.read("a", "minmax", (0, 1)).collect()) == [0, 1]
    s.write_parameters({"cutoff": 1.5, "sigma": None})
    s.write_parameters({"cutoff": 2.5, "sigma": None})
    assert s.parameters() == {"cutoff": 2.5, "sigma": 0}


def test_structure_text(spark, atoms, coords, tmp_path):
    rows = coords.where("frame < 2").join(atoms, ["traj_id", "atom_id"])
    text = pdb.block(rows.where("frame = 0"), ["traj_id"])
    line = text.where("traj_id = 0").first().text.split("\n")
    assert line[0].startswith("ATOM      1  N   ARG     1    ") and len(line[0]) == 66 and line[-2] == "TER" and line[7][12:16] == " OG1"
    for r in text.collect():
        (tmp_path / f"t{r.traj_id}.pdb").write_text(r.text)
    back = {(r.traj_id, r.atom_id): (r.atom_name, r.resname, r.resid, r.x) for r in pdb.read(spark, str(tmp_path)).collect()}
    want = {(f"t{r.traj_id}", r.atom_id): (r.atom_name, r.resname, r.resid, pytest.approx(r.x, abs=6e-4)) for r in rows.where("frame = 0").collect()}
    assert back == want
    pdb.write(text, str(tmp_path / "out"))
    assert sorted(r.traj_id for r in spark.read.text(str(tmp_path / "out")).select("traj_id").distinct().collect()) == [0, 1]
    models = spark.createDataFrame([("m", "MODEL 1\n" + line[0] + "\nENDMDL\nMODEL 2\n" + line[0] + "\n" + line[4] + "\n")], "traj_id string, text string")
    assert sorted((r.frame, r.atom_id, r.resid) for r in pdb.parse(models).collect()) == [(0, 0, 0), (1, 0, 0), (1, 1, 1)]
    many = spark.createDataFrame([("f", "@<TRIPOS>MOLECULE\na\n@<TRIPOS>MOLECULE\nb\n"), ("g", "x\n$$$$\ny\n$$$$\n")], "file string, text string")
    assert sorted((r.file, r.position) for r in pdb.molecules(many).collect()) == [("f", 0), ("f", 1), ("g", 0), ("g", 1)]
    head = spark.createDataFrame([("TITLE     A LONG\nTITLE    2 NAME\nSEQRES   1 A    4  ALA GLY\nSEQRES   1 B    1  SER\n",)], "t string")
    r = head.select(pdb.title(F.col("t")).alias("a"), pdb.sequence(F.col("t"), "A").alias("b")).first()
    assert r.b == ["ALA", "GLY"] and "LONG" in r.a and "NAME" in r.a


def test_loader(spark, atoms, coords):
    one = Loader.of_ids(atoms.select("traj_id").distinct(), coords, atoms, 2, ":LIG")
    assert one[0].frames().select("traj_id").distinct().count() == 1 and one[[0, 1]].frames().agg(F.max("frame")).first()[0] == 3
    assert one[1:].atoms().count() == 8 and one.append(atoms.select("traj_id").distinct()).manifest.agg(F.max("position")).first()[0] == 3


def test_stream(spark, coords, tmp_path):
    from orrery.streaming.ingest import featurize_stream

    schema = "traj_id long, frame int, atom_id int, x double, y double, z double"
    coords.where("traj_id = 0").write.parquet(str(tmp_path / "in"))
    run = lambda: featurize_stream(spark, str(tmp_path / "in"), schema, lambda b: windows.slices(b, 3).groupBy("traj_id", "slice_id").agg(F.avg("x").alias("m")), lambda b: b.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    coords.where("traj_id = 1").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_superpose(spark, atoms, coords):
    a = coords.where("traj_id = 0 and frame = 0")
    c, s = np.cos(1.0), np.sin(1.0)
    turned = a.select("traj_id", F.lit(1).alias("frame"), "atom_id", (c * F.col("x") - s * F.col("y") + 3).alias("x"), (s * F.col("x") + c * F.col("y") - 1).alias("y"), (F.col("z") + 2).alias("z"))
    out = superpose(a.unionByName(turned), atoms.where("atom_id < 10"))
    x = {(r.frame, r.atom_id): (r.x, r.y, r.z) for r in out.collect()}
    assert all(x[1, i] == pytest.approx(x[0, i]) for i in range(24))


def test_augment(spark):
    dims, rng = (3, 4, 5), np.random.default_rng(5)
    v = rng.random(dims)
    df = spark.createDataFrame([(0, *map(int, i), float(v[i])) for i in np.ndindex(dims)], "sample_id int, gx int, gy int, gz int, v double")

    def back(x, shape):
        out = np.zeros(shape)
        for r in x.collect():
            out[r.gx, r.gy, r.gz] = r.v
        return out

    assert np.array_equal(back(d.flip(df, dims, [0, 2]), dims), v[::-1, :, ::-1])
    assert np.array_equal(back(d.flip(d.flip(df, dims, [1]), dims, [1]), dims), v)
    for axis, plane in ((0, (1, 2)), (1, (0, 2)), (2, (0, 1))):
        for k in range(5):
            want = np.rot90(v, k, plane)
            assert np.array_equal(back(d.rot90(df, dims, axis, k), want.shape), want)
    want = np.zeros(dims)
    want[1:, :, :3] = v[:-1, :, 2:]
    assert np.array_equal(back(d.shift(df, dims, (1, 0, -2)), dims), want)
    noisy = back(d.noise(df, ["sample_id"], 1), dims)
    assert 0.03 < np.std(noisy - v) < 0.2


def test_hilbert():
    for order, dims in ((3, 3), (4, 2), (2, 3)):
        c = d._hilbert(order, dims)
        assert len(set(c)) == 1 << (order * dims) and c[0] == (0,) * dims
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(c, c[1:]))


def test_numbering_over_many_partitions(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "k")
    got = sorted((r.k, r.batch_id * 64 + r.place) for r in d.batches(df, 64, ["k"]).collect())
    assert got == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_keeps_every_row(spark, adaptive):
    """Many rows with other columns, of which some clash by name, in any order."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 300_000
        df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.md5(F.col("id").cast("string")).alias("text"), F.rand(1).alias("n")).repartition(23)
        got = d.batches(df, 1000, ["k"]).withColumn("number", F.col("batch_id") * 1000 + F.col("place"))
        r = got.agg(F.count("*"), F.countDistinct("number"), F.sum((F.col("number") != F.col("k")).cast("int")), F.countDistinct("text")).first()
        assert tuple(r) == (n, n, 0, n) and got.columns == ["k", "text", "n", "batch_id", "place", "number"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_numbering_of_ties_and_nothing(spark):
    df = spark.createDataFrame([(i % 3 if i % 4 else None, i) for i in range(50)], "k int, x int")
    got = d.batches(df, 7, ["k"]).collect()
    assert sorted(r.batch_id * 7 + r.place for r in got) == list(range(50)) and sorted(r.x for r in got) == list(range(50))
    assert d.batches(df.limit(0), 7, ["k"]).count() == 0


def test_metrics(spark):
    rng = np.random.default_rng(6)
    p, t = rng.integers(0, 9, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, t))], "k string, i int, p double, t double")
    i, j = np.triu_indices(60, 1)
    s, u = np.sign(p[i] - p[j]), np.sign(t[i] - t[j])
    assert metrics.kendall(df, "p", "t", ["k"], "i").first().kendall == pytest.approx((s * u).sum() / np.sqrt((s**2).sum() * (u**2).sum()))
    r = metrics.regression(df, "p", "t").first()
    assert (r.mse, r.r2, r.median_residual) == (pytest.approx(((p - t) ** 2).mean()), pytest.approx(1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum()), pytest.approx(np.median(abs(p - t))))
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert metrics.spearman(df, "p", "t", ["k"]).first().spearman == pytest.approx(np.corrcoef(rank(p), rank(t))[0, 1])


def test_nearest_prototype_without_pairs(spark):
    """Each query once, the least label of equals, no value furthest; and no plan that makes pairs."""
    rng = np.random.default_rng(9)
    q = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 6, (300, 2)))] + [(7000, None, 1.0), (7001, 2.0, 2.0), (7001, 2.0, 2.0)]
    p = [(int(k), float(a), float(b)) for k, (a, b) in zip(rng.permutation(30), rng.integers(0, 6, (30, 2)))] + [(-1, None, 2.0)]
    queries, prototypes = spark.createDataFrame(q, "id int, x double, y double"), spark.createDataFrame(p, "label int, x double, y double")
    out = d.nearest_prototype(queries, prototypes, ["x", "y"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan and "SortAggregate" not in plan
    s = [np.std([r[1] for r in p if r[1] is not None]), np.std([r[2] for r in p])]
    far = lambda a, b: np.inf if None in (*a, *b) else sum(((u - v) / w) ** 2 for u, v, w in zip(a, b, s))
    want = sorted((*r, min(p, key=lambda k: (far(r[1:], k[1:]), k[0]))[0]) for r in set(q) if r[1] is not None)
    got = sorted(tuple(r) for r in out.where("x is not null").collect())
    assert got == want and out.where("x is null").count() == 1
    assert d.nearest_prototype(queries, prototypes.limit(0), ["x", "y"]).count() == 0


def test_spearman_of_a_group_in_parts(spark):
    """Ties, nulls (which are the greatest), null keys and a constant side; a group's rows are sorted in no one task."""
    rng = np.random.default_rng(8)
    rows = [(g, float(a), float(b)) for g, n, m in (("a", 3000, 40), (None, 2000, 1000), ("c", 5, 1)) for a, b in zip(rng.integers(0, m, n), rng.integers(0, m, n) + rng.integers(0, m, n))]
    rows += [("a", None, 1.0), ("a", 3.0, None), ("a", None, None), ("d", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, p double, t double").repartition(5)
    parts = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranks = metrics.ranked(df.withColumn("one", F.lit(1)), "p", ["k"], "r", "one")
        assert ranks.where("k is null").select(F.spark_partition_id()).distinct().count() > 1
        got = {r.k: r.spearman for r in metrics.spearman(df, "p", "t", ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", parts)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    for k in ("a", None):
        p, t = (rank(np.array([np.inf if r[i] is None else r[i] for r in rows if r[0] == k])) for i in (1, 2))
        assert got[k] == pytest.approx(np.corrcoef(p, t)[0, 1])
    assert got["c"] is None and got["d"] is None and len(got) == 4
    assert metrics.spearman(df.where("k = 'a'"), "p", "t", []).count() == 1


def test_kendall_ties_and_nulls(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(a), float(b)) for g, n, m in (("a", 200, 5), ("b", 150, 1000), ("c", 1, 3), ("d", 9, 1)) for a, b in zip(rng.integers(0, m, n), rng.integers(0, m, n))] + [("a", None, 1.0)]
    got = {r.k: r.kendall for r in metrics.kendall(spark.createDataFrame(rows, "k string, p double, t double"), "p", "t", ["k"]).collect()}
    for k in "ab":
        p, t = np.array([r[1:] for r in rows if r[0] == k and r[1] is not None]).T
        i, j = np.triu_indices(len(p), 1)
        s, u = np.sign(p[i] - p[j]), np.sign(t[i] - t[j])
        assert got[k] == pytest.approx((s * u).sum() / np.sqrt((s**2).sum() * (u**2).sum()))
    assert got["c"] is None and got["d"] is None


@pytest.mark.parametrize("n, m, scale, shift", [(50, 80, (1, 1, 1), 0), (500, 3, (1, 1, 1), 0), (7, 1, (1, 1, 1), 1000), (300, 900, (1, 10, 100), 0), (90, 400, (1, 1, 0), 5), (40, 30, (1e-5, 1e-5, 1), 100), (20, 9, (0, 0, 0), 3)])
@pytest.mark.parametrize("whole", [True, False])
def test_nearest(n, m, scale, shift, whole):
    from orrery.operators.labels import nearest

    rng = np.random.default_rng(n)
    draw = (lambda k: rng.integers(0, 4, (k, 3)) * np.array(scale, float)) if whole else (lambda k: rng.normal(size=(k, 3)) * scale)
    p, q, ids = draw(n) + shift, draw(m), rng.permutation(2 * m)[:m]
    d = (p[:, None] - q[None]) ** 2
    d = d[..., 0] + d[..., 1] + d[..., 2]
    assert nearest(p, q, ids).tolist() == [min(zip(d[i], ids))[1] for i in range(n)]


def test_trajectory_files(spark, tmp_path):
    """Round trips in both formats; headers of other makers; frames in several partitions; refusals."""
    import struct

    from orrery.sources import trajectories as tr

    rng = np.random.default_rng(8)
    xyz = {t: rng.normal(size=(f, a, 3)).astype(np.float32) for t, f, a in (("one", 7, 5), ("two", 1, 1), ("three", 30, 11))}
    df = spark.createDataFrame([(t, f, a, *map(float, x[f, a])) for t, x in xyz.items() for f in range(len(x)) for a in range(x.shape[1])], "traj_id string, frame int, atom_id int, x double, y double, z double")
    for kind in ("dcd", "netcdf"):
        at = str(tmp_path / kind)
        assert sorted(r.frames for r in tr.write(df.repartition(5), at, kind).collect()) == [1, 7, 30]
        for stride in (1, 3):
            got = tr.read(spark, at, stride).collect()
            assert len(got) == sum(-(-len(x) // stride) * x.shape[1] for x in xyz.values())
            assert all(tuple(np.float32([r.x, r.y, r.z])) == tuple(xyz[r.traj_id][r.frame * stride, r.atom_id]) for r in got)
        (tmp_path / kind / "other.txt").write_text("neither of these formats")
        with pytest.raises(Exception, match="neither DCD nor"):
            tr.read(spark, at).count()
    with pytest.raises(Exception, match="not every frame"):
        tr.write(df.where("frame + atom_id <> 3"), str(tmp_path / "holes"))
    # big-endian DCD with a unit cell
    record = lambda b: struct.pack(">i", len(b)) + b + struct.pack(">i", len(b))
    control = [4, 0, 1] + [0] * 7 + [1] + [0] * 9
    frames = b"".join(record(bytes(48)) + b"".join(record(f[:, a].astype(">f4").tobytes()) for a in range(3)) for f in xyz["one"][:4])
    data = record(b"CORD" + struct.pack(">20i", *control)) + record(struct.pack(">i", 2) + bytes(160)) + record(struct.pack(">i", 5)) + frames
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "b.dcd").write_bytes(data)
    # NetCDF with another record variable, attributes, and doubles in the 64-bit format
    name = lambda s: struct.pack(">q", len(s)) + s + bytes(-len(s) % 4)
    q, i = lambda *v: struct.pack(f">{len(v)}q", *v), lambda *v: struct.pack(f">{len(v)}i", *v)
    def head(begin):
        dims = i(10) + q(3) + name(b"frame") + q(0) + name(b"atom") + q(5) + name(b"spatial") + q(3)
        time = name(b"time") + q(1) + q(0) + i(12) + q(1) + name(b"units") + i(2) + name(b"ps") + i(5) + q(4) + q(begin)
        return b"CDF\5" + q(4) + dims + i(0) + q(0) + i(11) + q(2) + time + name(b"coordinates") + q(3) + q(0, 1, 2) + i(0) + q(0) + i(6) + q(120) + q(begin + 4)
    n = len(head(0))
    (tmp_path / "big" / "n.nc").write_bytes(head(n) + b"".join(struct.pack(">f", k) + f.astype(">f8").tobytes() for k, f in enumerate(xyz["one"][:4])))
    got = tr.read(spark, str(tmp_path / "big")).collect()
    assert len(got) == 40 and all(tuple(np.float32([r.x, r.y, r.z])) == tuple(xyz["one"][r.frame, r.atom_id]) for r in got)


def test_frames_in_partitions(monkeypatch):
    from orrery.sources import trajectories as tr

    monkeypatch.setattr(tr, "PARTITION", 100)
    assert tr.Layout(10, 5, 0, 60, "<f4", False).size == 60


def test_structures_of_many_models(spark, tmp_path):
    line = "ATOM  {:5d}  CA  ALA A{:4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C"
    model = lambda k, n: "\n".join([f"MODEL     {k:4d}", *(line.format(i + 1, i // 2 + 1, k, i, 0.5) for i in range(n)), "ENDMDL"])
    (tmp_path / "m.pdb").write_text("TITLE x\n" + "\n".join(model(k, 4) for k in range(1, 200)) + "\nEND\n")
    (tmp_path / "s.pdb").write_text(line.format(1, 1, 9, 9, 9) + "\nEND\n")
    (tmp_path / "none.pdb").write_text("END\n")
    want = sorted([("m", f, i, i // 2, f + 1.0, float(i)) for f in range(199) for i in range(4)] + [("s", 0, 0, 0, 9.0, 9.0)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for whole in (False, True):
                assert sorted((r.traj_id, r.frame, r.atom_id, r.resid, r.x, r.y) for r in pdb.read(spark, str(tmp_path), whole).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "t.pdb").write_text(model(1, 1) + "\n" + model(1, 1))
    with pytest.raises(Exception, match="two models of one number in t"):
        pdb.read(spark, str(tmp_path)).collect()
    assert pdb.read(spark, str(tmp_path / "t.pdb"), True).select("frame").distinct().count() == 2


def test_label_files(spark, tmp_path):
    from orrery.sources.tables import read_labels, read_list

    (tmp_path / "l.csv").write_text("name,pdbcode,pK\nx, 1ABC ,5.5\ny,2xyz,\nz,,4\nw,1abc,7\nv,3q,zero\n")
    assert [(r.key, r.value) for r in read_labels(spark, str(tmp_path / "l.csv")).orderBy("position").collect()] == [("1abc", 5.5), ("1abc", 7.0)]
    with pytest.raises(ValueError, match="no column Kd"):
        read_labels(spark, str(tmp_path / "l.csv"), value="Kd")
    (tmp_path / "ids.txt").write_text("1ABC\n\n 2xyz \n1abc\n")
    assert [r.key for r in read_list(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()] == ["1abc", "2xyz", "1abc"]


def test_dispersion_of_a_crowded_cell(monkeypatch):
    from orrery.operators import observables as o

    rng = np.random.default_rng(9)
    w, axes = rng.random(60), [rng.normal(size=60) for _ in range(3)]
    d = np.sqrt(sum((x[:, None] - x[None]) ** 2 for x in axes))
    ww = np.outer(w, w) * (1 - np.eye(60))
    for most in (1 << 19, 700, 60, 1):
        monkeypatch.setattr(o, "PAIRS", most)
        far, total = o._pair_sums(w, axes)
        assert far / total == pytest.approx((ww * d).sum() / ww.sum())


def test_all_pairs(spark):
    from orrery.operators.similarity import all_pairs

    rng = np.random.default_rng(10)
    v = rng.normal(size=(23, 4))
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id int, embedding array<double>")
    for kind, f in (("euclidean", lambda a, b: np.linalg.norm(a - b)), ("manhattan", lambda a, b: np.abs(a - b).sum()), ("cosine", lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or np.inf))):
        got = {(r.a_id, r.b_id): r.v for r in all_pairs(df, df.where("vec_id < 5"), kind, block=4).collect()}
        assert len(got) == 23 * 5 and all(x == pytest.approx(f(v[i], v[j]), abs=1e-12) for (i, j), x in got.items())
    assert all_pairs(df, df.limit(0), "cosine").count() == 0


def test_scalars(spark):
    assert scalar.sample_rows(spark.range(50), 7, 1).count() == 7
    assert spark.range(1).select(scalar.stamp(F.timestamp_micros(F.lit(1_700_000_000_123_456)))).first()[0] == "231114_221320_3456"
    r = spark.sql("select array(0D, 0D) z, array(3D, 4D) a, array(1, 2, 2) s, array(2, 3) t").select(scalar.cosine(F.col("z"), F.col("a")), scalar.jaccard(F.col("s"), F.col("t")), scalar.euclidean(F.col("z"), F.col("a")), scalar.hash_text(F.lit("a"), "sha512")).first()
    assert tuple(r)[:3] == (0.0, pytest.approx(1 / 3), 5.0) and len(r[3]) == 128
    assert len(PAIR_CODE) == 400 and PAIR_CODE["VALALA"] == 380 and len(ELEMENTS) == 118 and BOND_LENGTH["O=C"] == BOND_LENGTH["C=O"]
    with pytest.raises(Exception, match="no electronegativity"):
        spark.range(1).select(scalar.element_property(F.lit(2), "electronegativity")).collect()
    v = spark.createDataFrame([(float("inf"),), (float("nan"),), (2.0,)], "v double").select(d.scrub("v").alias("v")).collect()
    assert [x.v for x in v] == [1.7976931348623157e308, 0.0, 2.0]
