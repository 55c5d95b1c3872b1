"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage works on all that its predecessor kept; between stages the documents are
written as Parquet to the shared folder and read again.  No SQL expresses the first
stage, so ``ORACLE_SQL`` is None; ``tests/llm`` holds every stage and ``run`` against
brute force on a small fixture.

Defined cases, by stage: null and empty texts are scored like others, are one empty line,
share one set of shingles (one of them stays) and pack as the end id alone; rows with a
null id are documents of their own but for line counts, where they count as one; repeated
rows score alike and one of them stays; texts of any length are read whole; ties go to
the smaller id; the first four stages pass all other columns through, whatever their
names; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelink.llm import line_dedup, packing, quality, simhash_dedup, toxicity
from notelink.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.3 or less go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three or more documents stay in the last document only."""
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 or more, by sets of five-word shingles, the document with the smallest id stays."""
    return simhash_dedup.keep_one(docs, words=simhash_dedup.STAGE_WORDS, similarity=simhash_dedup.SIMILARITY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, with_ids=False)


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("line_dedup", line_stage), ("simhash", near_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
