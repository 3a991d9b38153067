"""python -m orrery: lists and runs the registered queries, and looks into a feature store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .config import Settings
from .operators.dataset import voxel_percentile, voxel_slice
from .operators.grid import CELL


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("orrery", description=__doc__)
    p.add_argument("--settings", help="a JSON file")
    do = p.add_subparsers(dest="do", required=True)
    do.add_parser("queries", help="names of the queries")
    run = do.add_parser("run", help="a query over a folder of tables, into Parquet")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("out")
    view = {}
    for name, about in (("view-slice", "a plane of a sample's voxels, over their greatest"), ("view-voxel", "the cells of a sample at or above a percentile")):
        view[name] = do.add_parser(name, help=about)
        view[name].add_argument("store")
        view[name].add_argument("outkey")
        view[name].add_argument("sample", type=int)
    view["view-slice"].add_argument("--axis", choices=CELL, default="gz")
    view["view-slice"].add_argument("--at", type=int, default=0)
    view["view-voxel"].add_argument("--percentile", type=float, default=95)
    a = p.parse_args(argv)
    from .plans import catalog

    if a.do == "queries":
        print("\n".join(catalog.QUERIES))
        return
    spark = Settings.of(a.settings or {}).session()
    if a.do == "run":
        catalog.QUERIES[a.name](spark, a.tables).write.parquet(a.out)
        return
    from .sources.store import FeatureStore

    rows = FeatureStore(spark, a.store).read(a.outkey, samples=(a.sample, a.sample + 1)).where("gx is not null")
    if a.do == "view-voxel":
        for r in voxel_percentile(rows, ["sample_id"], a.percentile).orderBy(F.desc("v"), *CELL).toLocalIterator():
            print(r.gx, r.gy, r.gz, f"{r.v:.6g}")
        return
    across, down = (c for c in CELL if c != a.axis)
    cells = {(r[down], r[across]): r.share for r in voxel_slice(rows, a.axis, a.at, ["sample_id"]).toLocalIterator()}
    for y in range(max((y for y, _ in cells), default=-1) + 1):
        print(" ".join(f"{cells.get((y, x), 0.0):.3f}" for x in range(max(x for _, x in cells) + 1)))


if __name__ == "__main__":
    main(sys.argv[1:])
