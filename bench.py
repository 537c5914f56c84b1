"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from seqloom.plans.catalog import QUERIES  # noqa: E402
from seqloom.session import build_session  # noqa: E402

HEADLINE = [
    "kmer_category_counts_k9",
    "kmer_pile_summary",
    "kmer_ref_proteins_k9",
    "li_exact_overlap",
    "li_substring_first_match",
    "overlap_summary",
    "venn_counts",
    "exact_li_match",
    "dedup_provenance",
    "dedup_kept",
    "blast_summary",
    "annotation_summary",
    "box_stats",
    "list_to_fasta",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["qc_counts"](spark, sf_dir).collect()  # starts the JVM's machinery
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
