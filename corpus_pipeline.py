"""Training-data pipeline over documents: each stage's decisions take effect on the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import bpe, common, decontaminate, minhash_dedup, passages, toxicity

#: (name, function of spark, docs and sf_dir), in order.
STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("minhash_near_dedup", minhash_dedup.keep_one),
    ("substring_dedup", passages.cut_stage),
    ("benchmark_decontamination", decontaminate.drop_contaminated),
    ("bpe_encoding_and_decoding", bpe.encode_stage),
]

#: SQL can't express a trained network; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage, and what it needed is removed."""
    docs = common.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, common.tidied(stage)(spark, docs, sf_dir)
        common.drop(before)
    return docs
