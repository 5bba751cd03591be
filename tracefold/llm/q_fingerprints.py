"""Query of the document fingerprints over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm.common import llm_query, table
from tracefold.llm.multiset_hash import fingerprint_report


@llm_query("op10_multiset_hash")
def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
