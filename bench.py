"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from narralytics.catalog import load_all  # noqa: E402
from narralytics.session import build_session  # noqa: E402

HEADLINE = [
    "label_summary_long", "unaligned_rows_union", "bleu_corpus_score", "rouge_n_scores", "rouge_l_scores",
    "sentence_alignment", "greedy_token_match", "narrative_ratios", "retention_sweep", "stratified_split",
    "overlap_audit", "forced_wrong_labels", "topic_terms", "codebook_candidates", "nearest_neighbour_stats",
    "structured_parse_report", "hierarchical_contrasts", "label_bootstrap", "comparison_family", "telemetry_rollup",
]


def run(spark, entry, sf_dir: str) -> float:
    start = time.perf_counter()
    entry.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = build_session(f"local[{cpus}]", max(8, cpus), "narralytics-bench")
    catalog = load_all()
    names = sys.argv[1:] or HEADLINE
    run(spark, catalog["job_status_rollup"], sf_dir)  # start the executors and the Python workers once
    seconds = {}
    for name in names:
        seconds[name] = round(min(run(spark, catalog[name], sf_dir) for _ in range(repeats)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
