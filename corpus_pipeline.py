"""From raw documents to token ids: quality, near copies, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazetta.llm import jaccard_join, merge_dropout, mixing, quality_rules, secret_scan
from gazetta.llm.common import written

STAGES = [
    ("quality classifier", quality_rules.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("secret scans", secret_scan.stage),
    ("mixing sources to target weights", mixing.numbered_stage),
    ("SentencePiece encoding and decoding", merge_dropout.stage),
]

#: SQL can't express a trained classifier, the knapsack or the merge agenda.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
