"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lekha.plans import catalog
from lekha.session import local_session

HEADLINE = [
    "flagship_scored_pairs", "b1_clean_manuscript", "b8_encode", "b14_transliterate", "b15_sentences", "corpus_old_lines",
    "d1_frozen_hash_split", "d9_holdout_every_fourth", "e1_distinct_sentences", "e3_one_per_page", "f1_rejection_funnel",
    "f4_confidence_statistics", "f15_overlap", "f18_vocabulary_share", "f20_system_comparison", "g1_edit_distance",
    "g5_chrf", "g6_bleu", "g7_alignment_costs", "h2_top_k", "h7_greedy_decode", "h8_line_slots", "h13_forced_alignment",
    "h14_recovery_totals", "i1_medoid", "i2_position_votes", "i6_sample_disagreement",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(catalog.QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session(cores, "bench")
    catalog.QUERIES["d1_frozen_hash_split"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if "--all" in sys.argv:
            print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
