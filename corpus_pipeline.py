"""From raw documents to token blocks: quality, near-duplicates, contamination, mixture, tokens.

Null, blank and very short texts fail the quality rules; texts of any length pass through whole. Repeated rows
are one document for the near-duplicate stage, which keeps one; unrelated texts with equal or null ids all stay. Columns
that the stages don't need are carried along, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontamination, mixing, near_dedup, quality_rules, token_output
from leafmill.llm.common import materialize, table

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality_rules.keep(docs)),
    ("near-duplicates", lambda spark, docs, sf_dir: near_dedup.keep(docs)),
    ("benchmark decontamination", lambda spark, docs, sf_dir: decontamination.keep(docs, table(spark, sf_dir, "benchmark"))),
    ("mixing sources", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("token output", lambda spark, docs, sf_dir: token_output.read_blocks(token_output.write_blocks(docs))),
]

#: SQL has no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
