"""Wall time of the headline queries; prints one JSON line.

The tables are first copied into eight files each, as tables of any size are; a single small file would
be read by one task.  Every query runs once to warm up and then `BENCH_RUNS` times (default 3) into a
no-op sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioflow.queries import QUERIES, load_all  # noqa: E402
from folioflow.session import local_session  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["federated_search", "fuzzy_search", "keyword_index_match", "index_top_matches", "dedupe_hits", "variant_order",
            "merge_stored_chapters", "pending_chapters", "dedupe_chapters", "chapter_range", "context_window", "stored_chapter_lookup",
            "fallback_match", "stage_state", "library_listing", "windowed_rate", "throttled_progress", "task_state", "shelf_fold",
            "breadcrumbs", "delete_items", "resolve_urls", "page_links", "page_paragraphs", "search_cards", "clean_text",
            "normalised_text", "ad_lines", "txt_books", "html_books"]


def several_files(spark, folder: str, files: int = 8) -> str:
    """A copy of the tables below a folder, each in some files."""
    copy = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(Path(folder).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(files).write.parquet(f"{copy}/{path.name}")
    return copy


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    load_all()
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    sf = several_files(spark, given)
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(given).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
