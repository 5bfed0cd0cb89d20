"""Corpus preparation: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All stages but the last keep the columns of ``docs``, whatever their
names and however many.

Defined results, in every stage: an empty table gives an empty one; rows with a null
``doc_id`` are treated like any other (but are near duplicates of nothing); null texts
are never duplicates, contaminated or masked, stay null until packing and count as empty
there; repeated rows are treated each for itself, but of near duplicates one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import common, decontamination, minhash, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below the threshold of rejection.

    The model is fitted on ``labels`` outside the held-out fold, on those of their documents
    that are in ``docs``.  Null and empty texts get the score of the intercept; without any
    training row nothing is rejected.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least ``doc_id``.

    Of repeated rows one stays; texts without words and rows without ``doc_id`` all stay.
    """
    return minhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of ``benchmark`` within its error budget.

    Null and empty texts stay; blank and null items match nothing; an empty benchmark keeps all.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in angle brackets; ``n_chars`` follows."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in a sequence of 2048 tokens; an empty text has its end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Signatures, edit distances and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole ``documents`` table; what a stage wrote on its way is removed after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    point = common.mark()
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.remove_since(spark, point, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
