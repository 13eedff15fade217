"""Wall times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

import importlib
import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = ["rendered_lines", "static_rule_boxes", "item_table_lines", "labeled_values", "name_memory_hits", "region_boxes", "verdict_summary", "code_boxes"]
OPERATORS = ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_"]


def main() -> None:
    from veilgrid.session import local_session

    queries = importlib.import_module("__spark_entry__").queries()
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if n in queries] + [next((q for q in queries if q.startswith(p)), None) for p in OPERATORS]
    queries["rendered_lines"](spark, SF_DIR).limit(10).write.format("noop").mode("overwrite").save()  # starts the session's machinery
    times = {}
    for name in filter(None, names):
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "sum of query wall times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
