"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Runs the production shape of the pipeline: ingest (bind + normalise + derive
each contract table once, written partitioned by year), flags (alert table
written once), then every headline query against the written tables.
Each query is timed as the median of 3 warm runs of a full execution
(``noop`` sink: every row computed, nothing collected to the driver).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veeduria.plans import register_all  # noqa: E402
from veeduria.plans.catalog import ALL_BINDINGS, CATALOG, TEST, alerts_df, present  # noqa: E402
from veeduria.plans.context import Context  # noqa: E402
from veeduria.session import get_spark  # noqa: E402

HEADLINE = [
    "f01_split", "f02_jump", "f03_spike", "f04_hhi", "f06_octopus", "f08_dominance", "f09_vague",
    "f10_extension", "r01_alerts_shared", "r02_entity_score", "r03_supplier_score", "m13_contract_score",
    "r04_flag_summary", "r07_kpi", "r09_top_entities", "r11_geo_fanout", "r11_geo_modal", "r13_feed",
    "r24_weekly", "r25_month_modality", "r27_dossier_top", "r27_dossier_exact", "r31_composition",
    "r37_largest", "n08_dedupe", "st_weekly",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="veeduria-bench", shuffle_partitions=max(8, 2 * cpus))
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veeduria-bench-"))
    register_all()
    ctx = Context(spark, sf_dir, materialize=True)

    times: dict[str, float] = {}
    t0 = time.time()
    for b in ALL_BINDINGS:
        ctx.contracts(b, TEST)
    times["ingest"] = round(time.time() - t0, 3)
    t0 = time.time()
    alerts_df(ctx)
    times["flags_write"] = round(time.time() - t0, 3)

    names = [n for n in HEADLINE if n in CATALOG]
    for name in names:
        runs = []
        for _ in range(3):
            t0 = time.time()
            run(present(CATALOG[name].build(ctx)))
            runs.append(time.time() - t0)
        times[name] = round(statistics.median(runs), 3)

    total = round(sum(times[n] for n in names), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus,
                      "note": "ingest and flags_write are one-off steps, not in value"}))
    spark.stop()


if __name__ == "__main__":
    main()
