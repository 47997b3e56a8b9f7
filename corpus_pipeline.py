"""The training-data pipeline over ``documents``: five stages, each by one operator.

Every stage takes all rows that the one before it kept, as a table written and read
again, and returns the columns of ``documents``; the last adds ``copies``.  Texts are
changed by the secret stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm.common import stored, table
from trellis.llm.gam import good_documents
from trellis.llm.mixing import mixed
from trellis.llm.probminhash import without_near_duplicates
from trellis.llm.secret_scan import redacted
from trellis.llm.tiling import decontaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in whatever order of its passages."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask."""
    return redacted(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with how often each is taken."""
    return mixed(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mask_secrets", mask_secrets), ("mix", mix)]

#: no twin: the stages learn a model, sketch and iterate; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
