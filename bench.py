"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run in full (into the ``noop`` sink) once to warm up at the smallest
size and then once for time.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

QUERIES = (
    "a01_outcomes", "a02_median_latency", "a03_p95_latency", "a04_by_first_channel", "a05_top_questions", "a06_language_classes", "a07_ratings", "a08_no_answer", "a09_daily_outcomes", "a10_daily_answers", "a11_cited_share",
    "r05_search", "c01_chunks", "x01_mask", "u02_content_dedup", "s06_html_pages", "u23_escalation_states",
)


def main() -> None:
    from tessella.plans import all_queries
    from tessella.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in QUERIES:
        if os.path.isdir(small):
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
