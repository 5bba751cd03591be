"""Query of the quality classifier over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm.common import llm_query, table
from tracefold.llm.quality_mil import fit, score_quality


@llm_query("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
