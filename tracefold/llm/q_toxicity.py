"""Query of the toxicity scores over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm.common import llm_query, table
from tracefold.llm.toxicity import fit, score_toxicity


@llm_query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
