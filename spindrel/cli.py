"""Command line: `python -m spindrel.cli COMMAND --sf-dir DIR [--key value | --key=value | --flag]`."""

from __future__ import annotations

import sys


def arguments(argv: list[str]) -> dict[str, str]:
    """--k v, --k=v, and a bare --flag, which is true."""
    out, i = {}, 0
    while i < len(argv):
        if not argv[i].startswith("--"):
            raise SystemExit(f"not an option: {argv[i]}")
        key, eq, value = argv[i][2:].partition("=")
        if not eq and i + 1 < len(argv) and not argv[i + 1].startswith("--"):
            i, value = i + 1, argv[i + 1]
        out[key] = value if eq or value else "true"
        i += 1
    return out


#: Commands and the registered queries that each one runs.
COMMANDS = {
    "stats": ["items_stats", "top_tags", "tag_histogram", "query_stats", "selectivity_bins"],
    "verify-gt": ["truth_check"],
    "build-ivf": ["kmeans_s4"],
    "build-pertag": ["s6_per_tag"],
    "subset": ["stratified_subset"],
    "slice": ["dataset_slice"],
    "smoke": ["s0_topk", "s1_post_filter", "s4_label_ivf", "graph_s2"],
    "sweep": ["recall_by_config", "recall_summary", "pareto", "best_config"],
    "exp3": ["cost_fit", "planner_calibrate", "planner_lagrange", "oracle_choice", "misroutes"],
    "build-index": ["quantised_vectors", "tag_cardinality"],
    "exp4": ["engine_updates", "late_counters"],
    "tombstones": ["tombstone_drift", "merge_recall"],
    "exp5": ["applier_final_state"],
    "exp7": ["range_estimates", "estimate_log_error"],
}


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in COMMANDS:
        print("commands:", *COMMANDS)
        return 2
    from pyspark.sql import SparkSession

    from spindrel.plans import registry

    args = arguments(argv[1:])
    spark = SparkSession.builder.appName("spindrel").getOrCreate()
    for name in COMMANDS[argv[0]]:
        found = registry.QUERIES[name](spark, args["sf-dir"])
        if "out" in args:
            found.write.mode("append").json(f"{args['out']}/{name}")
        else:
            print(name)
            found.show(int(args.get("rows", 20)), truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
