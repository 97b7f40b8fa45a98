"""A corpus pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage works on all that the one before kept; its result is written and read again as the next one's documents.
All but the last return the columns of ``documents``, further ones included, whatever their names; an empty table passes through all
stages. Null doc_ids are kept as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seedquorum.llm import neardup, packing, passages, quality, toxicity
from seedquorum.plans.workspace import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 rejects go.

    Null and empty texts have no words and go; a text of any length is measured whole; repeated rows are judged alike.
    """
    return quality.passing(docs, "v2")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from labels of documents still there.

    Null and empty texts score 0 and stay; without labels of both kinds nothing goes; repeated rows score alike; an id that is
    listed twice with differing labels counts as toxic when fitting.
    """
    return toxicity.passing(docs, toxicity.fit_on_folds(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: five-word shingles, similarity 0.8 or more.

    The one of smallest id, a null id last. Texts without words are classes of their own. Rows of equal id and text are one
    document; rows of one id with different texts are judged by their texts.
    """
    return neardup.one_of_each(docs, k=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that another document has too leave the texts, every copy of them.

    White space between the words doesn't matter. A row stays even if its whole text goes; null texts stay null; n_chars follows the
    text. Rows of one id, null too, are one document.
    """
    return passages.without_repeats(docs, kind=passages.WORDS)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens: a row per piece.

    Null and empty texts are one piece of the end id; longer documents than a sequence are cut, the first piece being the shorter; repeated
    rows are packed each.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("minhash_near_dedup", minhash_dedup), ("suffix_dedup", passage_dedup), ("best_fit_packing", best_fit)]

#: MinHash classes, tokens and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
        if last:
            work.drop(last)
        last = name
    return docs
