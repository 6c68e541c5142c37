"""From raw documents to packed sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import stages
from gristmill.llm.common import drop_path, write_table

STAGES = [
    ("language_id", stages.identify_language),
    ("ngram_jaccard", stages.drop_near_duplicates),
    ("decontamination", stages.decontaminate),
    ("pii", stages.sanitise_pii),
    ("packing", stages.pack_sequences),
]

#: The stages' models and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's outcome is a written table, which goes when the next is there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            drop_path(spark, last)
        last = path
    return docs
