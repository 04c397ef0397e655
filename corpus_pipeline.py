"""A training-data pipeline of five operators over the documents table; counted as part of the subpackage ``tessera.llm``.

Each stage but the last returns the columns of its input, whatever they are; the columns read are doc_id and text. Defined cases: rows with a null or empty text pass the
filters, as nothing speaks against them, and are packed as documents of no units; rows with a null id pass all stages, each by itself, and are never taken for copies;
rows that repeat an id and text are kept once by the near join, an id with several texts is one document there and goes or stays as a whole; without labels of both
classes the classifier keeps all, and the toxicity grammar has only its base lists; without benchmark items nothing is contaminated; an empty table gives none.
What each stage writes lies in a folder of its own under the shared checkpoint folder, which whoever owns that folder clears.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near, packing, quality, toxicity
from tessera.llm.tables import table
from tessera.plans.checkpoints import ensure_checkpoint_dir


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training windows."""
    return packing.pack(docs)


STAGES = [("quality classifier", classified), ("toxicity", civil), ("n-gram Jaccard join", deduplicated), ("benchmark decontamination", decontaminated), ("packing", packed)]
#: No stage but the decontamination could be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again by the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
