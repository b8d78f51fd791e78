"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillstrata.catalog.queries import QUERIES  # noqa: E402
from quillstrata.session import local_session  # noqa: E402

HEADLINES = [
    "class_distribution_category",
    "class_distribution_intent",
    "length_stats",
    "percentile_stats",
    "dedup_stats",
    "full_profile",
    "quarantine_split",
    "validation_summary",
    "normalize_text",
    "sanitize_text",
    "pii_scan",
    "minhash_signature",
    "near_dup_candidates",
    "cluster_ids",
    "grouped_split",
    "read_sft_jsonl",
    "vocabulary_topk",
    "tfidf_weights",
    "per_class_metrics",
    "prepare_corpus",
    "train_and_evaluate",
]


def run(df) -> None:
    """Produce every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=8 if cores == "*" else int(cores))
    names = sys.argv[1:] or HEADLINES
    # Start the workers and compile the common paths once, on the same kind of query.
    run(QUERIES["class_distribution_category"](spark, sf_dir))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
