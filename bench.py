"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from affilia.operators import connectivity, graph, removal
from affilia.plans import analysis
from affilia.plans.queries import REGISTRY
from affilia.sources.views import SIZES, roster

#: The sparse roster of the sweep with betweenness: about 4 % of the line items; and its course sizes.
SPARSE, SPARSE_SIZES = "l_returnflag = 'R' and l_quantity >= 45", (5, 4, 3)

HEADLINE = ("course_cost", "course_degree", "rank_courses", "co_enrolment", "size_threshold_counts", "budget_prefix_summary", "budget_greedy_removed", "contract_students", "compress_graph", "connected_components")


def dense_blocks(spark, sf_dir):
    """Blocks of the dense roster, one component."""
    return connectivity.block_members(connectivity.block_edges(graph.vertex_edges(graph.memberships(roster(spark, sf_dir)))))


def sweep_ret45(spark, sf_dir):
    """The whole report over all budgets, exact betweenness included: the reference's main program."""
    rows = roster(spark, sf_dir, weighted=False, where=SPARSE)
    return analysis.sweep(rows, removal.budgets_of(graph.course_attributes(rows), SPARSE_SIZES))


def sweep_full(spark, sf_dir):
    """Inclusion, components and blocks of the full roster under all budgets."""
    rows = roster(spark, sf_dir, weighted=False)
    return analysis.sweep(rows, removal.budgets_of(graph.course_attributes(rows), SIZES), betweenness=False)


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: REGISTRY[name] for name in HEADLINE} | {"biconnected_components": lambda s, d: dense_blocks(s, d).select("block_id", "vid"), "cut_vertices": lambda s, d: connectivity.cut_vertices(dense_blocks(s, d)), "sweep_ret45": sweep_ret45, "sweep_full": sweep_full}
    REGISTRY["course_cost"](spark, sf_dir).count()  # starts the JVM's compilers and Python workers
    seconds = {}
    for name, run in runs.items():
        began = time.time()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
