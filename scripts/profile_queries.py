"""Profile registered queries with tracefold itself.

Runs the named queries in a session that writes an (uncompressed) event log into
a fresh scratch folder, then reads that log with ``read_event_log`` and reports,
per query (job group), the number of stages and tasks, the summed stage time,
and the slowest stages: the library analysing its own Spark runs.

Usage: python scripts/profile_queries.py SF_DIR QUERY [QUERY ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv: list[str]) -> None:
    sf_dir, names = argv[1], argv[2:]
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    log_dir = tempfile.mkdtemp(prefix="tracefold-profile-")
    spark = (
        SparkSession.builder.master("local[8]").appName("tracefold-profile")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false").config("spark.sql.shuffle.partitions", "16")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tracefold.plans.catalog import all_queries
    from tracefold.plans.context import ingest

    ingest(spark, sf_dir)
    qs = all_queries()
    for n in names:
        spark.sparkContext.setJobGroup(n, n)
        t0 = time.perf_counter()
        qs[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"{n}: {time.perf_counter() - t0:.2f}s wall")
    spark.sparkContext.setJobGroup("profile-read", "profile-read")

    from tracefold.operators import entities
    from tracefold.sources import eventlog

    lc = eventlog.read_event_log(spark, log_dir)
    jobs = entities.pair_jobs(lc).where(F.col("job_group").isin(*names))
    stages = entities.pair_stages(lc).withColumn("stage_ms", F.col("completion_ms") - F.col("submission_ms"))
    pairs = entities.job_stage_infos(jobs).join(jobs.select("app_id", "job_id", "job_group"), ["app_id", "job_id"])
    per = stages.join(pairs.select("app_id", "stage_id", "job_group"), ["app_id", "stage_id"])
    per.groupBy("job_group").agg(
        F.count(F.lit(1)).alias("stages"), F.sum("num_tasks").alias("tasks"), F.sum("stage_ms").alias("stage_ms")
    ).orderBy("job_group").show(truncate=False)
    per.orderBy(F.desc("stage_ms")).select("job_group", "stage_id", "num_tasks", "stage_ms").show(10, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
