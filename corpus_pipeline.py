"""Corpus preparation in five stages; each stage's rows are written as Parquet and reread by the next.

The near-duplicate and packing stages have no equivalent in SQL, so ``ORACLE_SQL`` is None; tests compare each stage with a plain
restatement of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm.decontaminate import drop_leaking
from evigraph.llm.line_dedup import line_marks, remove_lines
from evigraph.llm.minhash import keep_one
from evigraph.llm.packing import pack, tokenizer_path
from evigraph.llm.quality_rules import keep_good
from evigraph.llm.shared import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line is alike to; the number of characters follows the text."""
    from pyspark.sql import functions as F

    left = remove_lines(docs, line_marks(docs))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("decontamination", benchmark), ("best_fit_packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
