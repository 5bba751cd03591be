"""Query of the personal data over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm.common import llm_query, table
from tracefold.llm.pii import pii_report


@llm_query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))
