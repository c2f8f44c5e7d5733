"""Time the headline queries and print one JSON line.

Every query is written to the no-op sink, so all rows and columns are computed and none reach the
driver.  One untimed run warms the JVM up; the time is the best of BENCH_RUNS (3) runs.
"""

from __future__ import annotations

import json
import os
import time

from stayspark.registry import QUERIES
from stayspark.session import local_session

HEADLINE = [
    "revenue_at_risk",
    "portfolio_totals",
    "loss_concentration_top3",
    "rating_vs_cancel_corr",
    "rank_disagreement",
    "revenue_identity_violations",
    "reconcile_totals",
    "invoice_amounts",
    "stay_invoice_amounts",
    "invoice_mismatch",
    "multi_line_invoices_top5",
    "underbilling_audit",
    "unreviewed_bookings",
    "chronology_violations",
    "pk_duplicates",
    "fk_orphans_all",
    "check_violations",
    "quality_summary",
    "apply_insert",
    "apply_update",
    "apply_update_by_column",
    "apply_delete",
    "typed_ingest_clean",
    "typed_ingest_rejects",
    "lookup_keys",
    "batch_ids",
    "table_profile",
    "table_fingerprint",
    "doc_project",
    "doc_delete_first",
    "gen_customers",
    "gen_invoices",
    "gen_revenue_at_risk",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cores, app="stayspark-bench")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 4)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
