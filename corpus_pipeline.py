"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's docs.

1. toxicity: a network trained on the labels of the same folder scores every document; those from 0.5 on go.
2. simhash: one document of each near-duplicate group stays (3-word shingles, 2 bits).
3. pii: personal data is masked, revealing terms are generalised or removed.
4. mixing: sources are mixed to their target weights; the rows come in training order, a second pass over a
   document is a row of its own, and a source's last document is cut where its target ends.
5. packing: the mixed documents as pieces of 4096-token sequences (one row per piece).

All stages but the last return the columns of ``documents``. Nulls, empty and repeated rows, empty tables and
extra columns are taken as the stage's operator describes; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import table, written
from tracefold.llm.mixing import mixed_documents
from tracefold.llm.packing import pack
from tracefold.llm.pii import sanitise
from tracefold.llm.simhash import keep_one
from tracefold.llm.toxicity import fit, toxicity
from tracefold.session import with_conf

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the labels only train."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(toxicity(F.col("text"), net) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return keep_one(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with masked texts and their new lengths (a null text has none)."""
    masked = sanitise(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, in training order."""
    return mixed_documents(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network, connected components, a tokenizer and a linear program: not expressible in SQL. The tests
#: hold each stage against a brute-force version instead.
ORACLE_SQL = None


#: Whole texts that pass between Spark and a Python worker at once: what both sides hold of them stays some MB.
TEXTS_PER_BATCH = 500


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with with_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch=TEXTS_PER_BATCH):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
