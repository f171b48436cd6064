"""Headline queries, timed one after the other; prints one JSON line.

``BENCH_SF_DIR`` picks the data, ``BENCH_CPUS`` the local cores.  Every query runs to the
end into the noop sink, with all its columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqmine.demo import catalog  # noqa: E402
from seqmine.session import builder  # noqa: E402

HEADLINE = ("segment_constant_stride", "assemble_groups", "stitch_groups", "segment_by_gap", "islands", "fill_audio",
            "assign_parent", "overlap_join", "split_intervals", "longest_disjoint", "max_overlap", "assign_lanes",
            "infer_interval", "number_frames", "carve", "apply_patches", "classify", "slice_items")


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (builder("seqmine-bench").master(f"local[{cpus}]")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    spent = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, d).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
