"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from bindings import registry  # noqa: E402
from bindings.session import local_session  # noqa: E402

HEADLINE = (
    "counts_by_type", "scrub_value", "detect_pii", "purity_check", "attestation_chain", "merge_pii_islands", "phi_zones",
    "file_counts", "language_inventory", "source_symbols", "env_inventory", "manifest_dependencies", "union_routes",
    "import_edges", "hub_files", "rank_sources_capped", "repo_fingerprints", "pattern_fuzzy_match", "fitness_running",
    "fitness_update", "overall_score", "findings_by_severity", "token_cost", "hash_embed",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "20g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        # every column of every row is computed, nothing is collected
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
