"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

$BENCH_RUNS (default 3) timed runs per query after one untimed start-up query; the median counts. Every
query is run in full and its rows are discarded by Spark's noop sink. ``duckdb`` has the times of the same queries' SQL
on the same files with as many threads, each run once (left out with $BENCH_DUCKDB=0), ``ratio`` ours over theirs in total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftlink.registry import QUERIES  # noqa: E402
from weftlink.session import build_session  # noqa: E402

HEADLINE = [
    "cosine_edge_profile",
    "cosine_top_links",
    "cosine_keyset_matrix",
    "link_midrank_stage1",
    "jaccard_edge_profile",
    "jaccard_top_links",
    "jaccard_keyset_matrix",
    "link_midrank_stage2",
    "linked_pairs_combined",
    "citations_extracted",
    "resolve_citations",
    "definitions_prepared",
    "clean_html_text",
    "title_abstract_text",
    "ctfidf_top_words",
    "distinct_on_first",
    "library_item_rows",
    "global_row_id",
]


def duckdb_seconds(sf_dir: str, names: list[str], threads: str) -> dict[str, float]:
    """Seconds of each query's SQL form, all rows fetched."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = {int(threads)}")
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    seconds = {}
    for name in names:
        if QUERIES[name].sql:
            start = time.perf_counter()
            con.execute(QUERIES[name].sql).fetch_record_batch(1 << 16).read_all()
            seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["distinct_on_first"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf}
    if os.environ.get("BENCH_DUCKDB", "1") != "0":
        beside = duckdb_seconds(sf_dir, names, cpus)
        compared = sum(seconds[n] for n in beside)
        result |= {"duckdb": beside, "ratio": round(compared / max(sum(beside.values()), 1e-3), 2)}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
