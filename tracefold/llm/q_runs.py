"""Query of the periodic runs over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm.common import llm_query, table
from tracefold.llm.periodic_runs import periodic_runs


@llm_query("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), loops=True)
