"""Registered queries against DuckDB where trajectories have numbers beyond those of the test tables."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orrery.plans import catalog

SF = "/root/testdata/sf0.001"


def same_rows(spark, folder, name, trajectories):
    """The query and its SQL agree where the first vectors are the atoms of these trajectories; the rows."""
    if not os.path.exists(SF):
        pytest.skip("needs the driver's tables")
    db = duckdb.connect()
    e = pq.read_table(f"{SF}/embeddings.parquet").slice(0, 100 * len(trajectories))
    ids = pa.array([100 * j + i for j in trajectories for i in range(100)], pa.int64())
    pq.write_table(e.set_column(e.schema.get_field_index("vec_id"), "vec_id", ids), f"{folder}/embeddings.parquet")
    for t in ("part", "orders"):
        os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    for t in ("part", "orders", "embeddings"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    ours = catalog.QUERIES[name](spark, str(folder))
    columns = ours.columns
    rows = sorted((tuple(r) for r in ours.collect()), key=repr)
    theirs = sorted(db.execute(f"select {', '.join(columns)} from ({catalog.SQL[name]}) as q").fetchall(), key=repr)
    assert rows and rows == theirs
    return rows


@pytest.mark.parametrize("name", ["label_affinity", "label_stepping", "label_rmsd", "label_pcdt"])
def test_trajectories_without_a_label(spark, tmp_path, name):
    rows = same_rows(spark, tmp_path, name, [1, 7, 1046])
    assert {r[0] for r in rows} == {1, 7, 1046} and (name == "label_stepping" or all((r[-1] is None) == (r[0] == 1046) for r in rows))


def test_foci_of_named_trajectories_only(spark, tmp_path):
    assert {r[0] for r in same_rows(spark, tmp_path, "focus_json", [0, 2, 77])} == {0, 2}


def test_added_samples_replace_none(spark, tmp_path):
    """Samples of trajectory 47 and of 48 have the numbers that added ones of 0 get."""
    rows = same_rows(spark, tmp_path, "store_update", [0, 47, 48])
    assert len({r[:-1] for r in rows}) < len(rows)
