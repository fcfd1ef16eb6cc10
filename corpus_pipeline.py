"""The corpus pipeline: each stage works on all that the one before kept; all but the last return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgauge.llm import decontaminate, language, near_join, pieces, quality
from vitalgauge.llm.common import saved, table

# Smallest probability of the best grade (good and not toxic) with which a document stays.
LEAST_GOOD = 0.5


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade reaches LEAST_GOOD."""
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")), n_grades=3)
    out = _fresh(docs, "quality_of_text")
    return quality.score(docs, model, out=out).where(F.col(out)["tails"][1] >= LEAST_GOOD).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept."""
    out = _fresh(docs, "language_of_text")
    return language.identify(docs, language.train(docs), out=out).where(F.col(out)["accepted"]).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8 or more)."""
    return near_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    out = _fresh(docs, "holds_item")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), out=out)
    return found.where(~F.col(out)).select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with the score of the segmentation and of the runner-up."""
    return pieces.encode(docs.select("doc_id", "text"), out="encoded").select("doc_id", "encoded.*")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

# Models and classes can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
