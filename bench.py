"""Bench: time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Every query is run to completion with the ``noop`` sink (all rows, all
columns computed, nothing collected). Model calls use the offline
letter-rotation backends, so the times are pipeline time without model
latency. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "translate_pages",
    "report",
    "page_groups",
    "segments_pages",
    "segment_requests",
    "validate_fit",
    "chunk_assembly",
    "rate_check",
    "match_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="tessera-bench")
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
