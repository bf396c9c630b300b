"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from deskwise import catalog
from deskwise.session import get_spark

HEADLINE = (
    "clean_pairs", "clean_funnel", "clean_strict", "history_table", "dedupe_first", "guard_by_message",
    "stratified_split", "shuffle_pos", "training_sample", "combined_training", "tfidf_long",
    "semantic_top50", "semantic_top50_grid", "retrieve_top5", "retrieved_wide", "describe_similarity",
    "class_report", "confusion_matrix", "escalate_all_reasons", "resp_summary", "triage_runtime",
    "triage_batch", "failure_modes", "lang_model", "lr_triage", "stream_triage",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="deskwise-bench-"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("clean_pairs", "retrieve_top5"):  # start the JVM's and the Python workers' engines
        run(name)
    times = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
