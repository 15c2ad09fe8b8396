"""A training corpus from the documents table: toxicity, exact and near copies, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Stages keep or
drop each row by its own text (and, for copies, by id and text together), so rows that share an id, or have none, are told
apart. Columns beyond those of documents are kept, whatever their names. An empty table goes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderlake.llm import decontaminate, exact_dedup, jaccard_join, mixing, toxicity
from cinderlake.llm.common import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that score one half or more. Null and empty texts score as a text without words; null ids, labels other than 0
    and 1, and tables without labels of both classes are handled as toxicity.py says. Repeated rows are judged alike."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of rows with equal normalised text (null counts as empty), the one with the smallest id; null ids stay only where
    a group has no other. Rows equal in id and text leave one, the least by its other columns."""
    return exact_dedup.drop_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar documents (5 words, 0.8), the one with the smallest id, null ids last; among rows
    of one id and one word sequence the least by its other columns. Rows without words are all kept."""
    return jaccard_join.one_of_each(docs, k=5, t=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark window; null texts have none. Repeated rows are judged alike."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mixture uses, once for each epoch, with mix_epoch. Null texts have no tokens, null languages and sources
    count as ''; rows of one id in one leaf are taken together."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("mix_sources", mix_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs


#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None
