"""Wall time of the headline queries; prints one JSON line.

Each query is written to Spark's ``noop`` sink, so every column of every row is
computed. ``BENCH_ONLY`` (comma-separated prefixes) narrows the list, ``BENCH_ALL=1``
runs every registered query.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire import plans  # noqa: E402
from quire.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_select_preview_assemble",
    "s10_result_fingerprint",
    "s11_verify_results",
    "v8_option_issues",
    "v9_preflight_report",
    "v14_unique_names",
    "v17_infer_route",
    "p3_select_pages",
    "p12_merge_documents",
    "p13_edit_pages_web",
    "p16_assemble_markdown",
    "p22_search",
    "r5_paragraph_aggregate",
    "r8_drop_native_duplicates",
    "r17_reading_order",
    "r20_chain_groups",
    "t1_chunk_text",
    "t2_even_sample",
    "t5_decode_replies",
    "t8_retry_schedule",
    "t10_resume_best_snapshot",
    "t17_align_boundaries",
    "h3_html_to_markdown",
    "h4_html_blocks",
    "h10_markdown_to_html",
    "h12_expand_sheet_runs",
    "j2_sticky_cancel",
    "j4_append_log",
    "j11_stream_job_state",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(plans.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    if only:
        names = [n for n in plans.QUERIES if any(n.startswith(p) for p in only)]
    spark = local_session(cores, app="quire-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One throw-away run starts the Python workers and warms the JVM.
    plans.QUERIES["r17_reading_order"](spark, sf_dir.replace("sf0.1", "sf0.001") if sf_dir.endswith("sf0.1") else sf_dir).write.format(
        "noop"
    ).mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
