"""The training-data pipeline: five stages over documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinelake.llm import decontam, langid, mixing, near_dedup, token_files
from kinelake.llm._common import table, written

STAGES = [
    ("language ID", langid.keep_identified),
    ("MinHash near-dedup", near_dedup.keep_one_of_each),
    ("benchmark decontamination", decontam.keep_clean),
    ("mixing sources to target weights", mixing.mix_documents),
    ("token-ID / binary output", token_files.encode_documents),
]

#: The stages train models and draw samples, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on all that its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
