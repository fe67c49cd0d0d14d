"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs to a no-op sink: once to warm up, then timed ``$BENCH_RUNS``
times (default 1); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from markwise.operators import bootstrap
from markwise.plans.registry import all_queries
from markwise.plans.runs import _outcomes
from markwise.session import build_session

HEADLINE = (
    "score_modes", "chance_levels", "tabulate_runs", "judge_recovery", "parse_standard", "score_mixed_models",
    "resume_pending", "cached_lookup", "upsert_override", "asof_floor", "asof_nearest", "time_compaction",
    "gap_trim", "merge_intervals", "exclusive_match", "subsample_keep", "uniform_sample", "clip_chunks_a",
    "stage_transitions", "mask_iou", "visible_edges", "non_edges", "pick_parts_area", "make_2part",
    "annotated_questions", "shuffle_options", "render_conversation", "chat_messages", "pack_batches",
    "stream_scoreboard",
)


def bootstrap_100k(spark, sf_dir):
    """The default of the interval: 100 000 iterations of 50 clusters, for every run."""
    trials = bootstrap.bootstrap_trials(_outcomes(spark, sf_dir), "video_id", ["human", "model"])
    return bootstrap.confidence_interval(trials, ["human", "model", "gap"])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        },
    )
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    catalog = {name: query.build for name, query in all_queries().items()}
    wanted = {name: catalog[name] for name in HEADLINE}
    wanted["bootstrap_100k"] = bootstrap_100k
    if len(sys.argv) > 1:
        wanted = {name: build for name, build in {**catalog, **wanted}.items() if name in sys.argv[1:]}
    times = {}
    for name, build in wanted.items():
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
