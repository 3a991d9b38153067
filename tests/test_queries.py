"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from orrery.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A sample over all kinds; the driver compares every query at the next size.
NAMES = ["mo_direct_count_mean", "mo_dispersion", "mo_eccentricity_median", "pdf_entropy", "voxel_static", "agg_drift", "mask_within", "crop_by_residue", "focus_json", "label_pcdt", "residue_pairs", "clash_counts", "featurize", "stratified_split", "segment_pick", "rotate_grid", "run_partition", "pdb_block", "scan_dcd", "scan_netcdf", "scan_labels", "scan_list", "prop_mass", "prop_table", "prop_aromaticity", "prop_not_aromatic", "prop_ring", "prop_donor", "prop_acceptor", "prop_hybridization", "hilbert_pool", "hilbert_pool_mean", "featurize_residues", "sim_all_cosine", "sim_all_euclidean", "sim_all_manhattan", "metric_kendall", "pcdt_pairs", "batch_split", "pdb_lines", "mo_direct_count_entropy"]


@pytest.fixture(scope="module")
def db():
    if not os.path.exists(SF):
        pytest.skip("needs the driver's tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, db, name):
    ours = catalog.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=repr)
    theirs = sorted(db.execute(f"select {', '.join(columns)} from ({catalog.SQL[name]}) as q").fetchall(), key=repr)
    assert rows and rows == theirs


def test_every_query_has_sql_or_a_reason():
    assert {n for n in catalog.QUERIES if n not in catalog.SQL} == {"superpose", "augment_noise", "feature_store", "random_forest", "rf_score"}
