"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and calls one operator:
quality rules drop rejected documents, the n-gram Jaccard join leaves one document of each group of near
duplicates (five-word shingles, similarity 0.8), secret scans redact, mixing repeats or leaves out documents to
meet the sources' targets, and best-fit packing lays all tokens into sequences of 1024.
All but the last return the columns that they were given. ``run`` writes each result as Parquet in the shared
folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import jaccard, mixing, packing, quality, secrets
from sievewright.llm.common import Stages, table
from sievewright.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts fail the base rule; an empty table stays empty."""
    return quality.passing(docs, Stages(spark))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id (null last); rows without words all stay."""
    return jaccard.one_of_each(docs, Stages(spark), k=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced and n_chars follows; all rows stay. A null text has none."""
    return secrets.redact(docs, secrets.forest(spark))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out, so that each source's words come near its target. A row without words is taken no time; repeated rows are rows of their own, and rows of one source and size are told apart by a hash of id and text."""
    return mixing.applied(docs, Stages(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences. A null text is an empty document; repeated rows are packed each, and pieces of one length are interchangeable."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), Stages(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Components, forests and packing are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, between = table(spark, sf_dir, "documents"), Stages(spark)
    for name, stage in STAGES[:-1]:
        docs = between.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
