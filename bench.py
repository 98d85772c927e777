"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (full computation, no
driver collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import catalog  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

# Headline queries: one per pipeline stage of the workload.
HEADLINE = (
    "word_frequency", "theme_distribution", "clean_filings", "kept_sections", "edgar_blocks",
    "filing_outcomes", "html_text", "html_flat", "sentence_chunks", "chunk_corpus", "extract_dates",
    "speech_sample", "speech_tokens", "phrase_scores", "phrase_tokens", "dictionary", "bag_of_words",
    "ctfidf_words", "topic_info", "dominant_topic", "dump_terms", "topic_summary",
    "categorized_documents", "coherence_cv", "topic_map_terms", "lda_theta", "cluster_topics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=max(int(cpus) * 2, 8))
    qs = catalog.queries()
    only = os.environ.get("BENCH_QUERIES")
    names = [n for n in (only.split(",") if only else HEADLINE) if n in qs]
    # One-time JVM/JIT warm-up: the first text query on the smallest data set,
    # so the first timed query is not charged for compiling the regex/codegen paths.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if names and os.path.isdir(warm_dir):
        qs[names[0]](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()          # includes eager steps (checkpoints, model fits)
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
