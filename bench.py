"""Times of the assembly's stages and headline queries; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"
    from pyspark.sql import SparkSession

    from readweave.plans import queries as Q

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, run):
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)

    # Stages are written tables, so each later one starts from the one before.
    for name in ("raw", "reads", "cands", "edges", "nodes", "paths"):
        timed(f"stage_{name}", lambda: Q.stage(spark, SF_DIR, name).count())
    for name in ("kmer_count", "substring_locate", "edge_support", "missing_mirror", "tips_pass1", "bubbles_pass1", "suffix_rank", "tips_fixpoint", "cleaned_graph", "dead_end_walk", "unitigs", "contigs"):
        timed(name, lambda: Q.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
