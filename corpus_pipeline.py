"""Training-data pipeline over `documents`: each stage calls one operator of tracewell.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. Every stage but the last returns the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import stages
from tracewell.llm.common import materialise

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate),
    ("tokenize", stages.tokenize),
]

#: Language ID, near-dedup and tokenising have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`, each on the table that its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
