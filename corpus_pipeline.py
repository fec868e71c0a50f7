"""From raw documents to packed sequences, in five stages over whole tables.

Each stage takes what its predecessor kept, lets its decision take effect and, but for
the last, returns the columns of ``documents``; between stages the rows are written as
Parquet and read again.

Defined cases, in every stage: a null text counts as empty and is judged like one; texts of
any length are read whole; a null id is an id like any other; rows that repeat id and text
leave the exact dedup once, rows that repeat an id over different texts are told apart by
text; of equal texts the largest id stays, of near copies the smallest; an empty table gives
an empty result; further columns, whatever their names, are handed on unread.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowtide.llm import exact_dedup, packing, simhash, toxicity, weak_quality
from rowtide.llm.common import checkpoint_dir, remove, rest, table
from rowtide.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity_model(spark, docs, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_quality.keep_good(docs, weak_quality.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, words=5, similarity=(4, 5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def rested(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` on executors that first gave back what the one before it needed."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rest(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", rested(drop_toxic)),
    ("quality classifier", rested(drop_low_quality)),
    ("exact dedup", rested(drop_copies)),
    ("simhash near-dedup", rested(drop_near_copies)),
    ("best-fit packing", rested(pack)),
]

#: Learned scores and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written to the shared folder, and
    deleted once the next stage's rows are there.

    The last stage reads its documents while it is called (its plan goes on from lengths
    written apart), so nothing of them is needed afterwards.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, base)
    return packed
