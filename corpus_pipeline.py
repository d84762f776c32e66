"""Clean a corpus: drop toxic documents and site boilerplate, keep one of near copies, drop test
items, and encode what is left.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the
columns of `documents`; the last returns token counts and digests. `run` writes each result as
Parquet to the shared checkpoint folder and reads it again for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from pagemill.llm.common import fold, table
from pagemill.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model learned as in the query of the operator."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    model = toxicity.train(table(spark, sf_dir, "documents"), labels)
    return toxicity.drop_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that too many documents of their source hold. No document goes."""
    return line_dedup.drop_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies."""
    return jaccard.keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = decontaminate.question_and_answer(table(spark, sf_dir, "benchmark"))
    return decontaminate.drop_leaks(docs, items)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the decoded text."""
    machine = bpe.compile_merges(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return bpe.encode_documents(docs, machine)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_test_items),
    ("bpe", encode),
]

# Training a classifier is beyond SQL; tests hold run() against a plain-Python pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
