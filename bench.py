"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to completion over its whole tables into the noop sink. The first, untimed step starts
the Python workers and loads the tables' footers.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from palimpsest import session  # noqa: E402
from palimpsest.plans import registry  # noqa: E402
from palimpsest.plans.catalog import Tables  # noqa: E402

HEADLINE = [
    "revision_pairs",            # which documents are versions of each other
    "revision_changes",          # … and every change between them
    "ag1_change_counts",         # full comparison of the corpus with an edited copy
    "jn13_best_version", "jn14_thread_match", "jn21_prior_hints", "jn16_attached_decisions",
    "wn14_paragraphs", "wn17_list_numbers", "ag5_patterns", "ag6_change_density", "ag29_prior_revisions",
    "jn29_differing_pixels",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (session.builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    registry.QUERIES["jn8_token_scripts"](Tables(spark, folder)).limit(1).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        t = time.perf_counter()
        registry.QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
