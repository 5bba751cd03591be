"""Query of the license scan over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm.common import llm_query, table
from tracefold.llm.licenses import license_scan


@llm_query("op6_licenses")
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
