"""Batch pipeline: every registered query over one input directory, results written as
parquet tables (A15) under an output directory on the shared filesystem.

    python -m cohortcast.plans.pipeline --sf /root/testdata/sf0.1 --out /shared/results [names...]

The stages share their expensive intermediates through the session: the cells view
and the size-checked small tables are materialised once (``cells_checkpointed``,
``small_table``), and the two-pass operators checkpoint their narrow inputs, so a lost
executor recomputes from the checkpoint directory rather than from the fact scans.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import SparkSession

from .registry import all_queries


def run(spark: SparkSession, sf_dir: str, out_dir: str, names: list[str] | None = None) -> dict[str, float]:
    reg = all_queries()
    times: dict[str, float] = {}
    for name in names or list(reg):
        t0 = time.time()
        reg[name].build(spark, sf_dir).write.mode("overwrite").parquet(os.path.join(out_dir, name))
        times[name] = round(time.time() - t0, 3)
    return times


def main(argv=None) -> int:
    from ..session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    print(json.dumps(run(spark, args.sf, args.out, args.names or None)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
