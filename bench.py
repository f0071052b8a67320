"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``ingest`` derives the ledger and writes it once, as an upload would, and
``rollups`` its maintained states; the other queries then read the written
tables.  Every result is consumed in full.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

HEADLINE = [
    "ap_aging", "overdue_debtors_30_60_90", "gst_summary", "vendor_ledger", "sales_register", "cash_flow_monthly",
    "budget_variance", "dashboard_cards", "chk_duplicates", "scan", "recon_run", "flux", "pl_triggers",
    "readiness_score", "scan_26q", "scan_gstr1", "doc_recon_summary", "map_columns", "strip_pii", "similar_questions",
    "vector_topk", "keyword_retrieval", "pulse_digest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from ledgerloom.session import local_session

    spark = local_session(cpus, cpus)
    from ledgerloom.plans import catalog
    from ledgerloom.plans.registry import Data

    spark.range(1).count()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    # a fixed job, so that rounds on machines of different speed compare
    calibrate = time.perf_counter()
    spark.range(200_000_000).selectExpr("sum(hash(id))").collect()
    calibrate = round(time.perf_counter() - calibrate, 3)
    timed("ingest", lambda: Data(spark, sf_dir).gl_all)
    timed("rollups", lambda: Data(spark, sf_dir).rollups)
    for name in HEADLINE:
        timed(name, lambda n=name: catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total wall-clock of ingest and headline ledger queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "calibration": calibrate, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
