"""A corpus from raw documents to packed sequences; part of the subpackage ``itemflow.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All stages but the last return
the columns of their input, whatever those are called.

Rows with a null text stay and are packed as their end token; empty and very long texts are texts like others.  Rows
without a doc_id are judged by their text, but have no near copies.  Rows that share a doc_id are one document: they
stay or go together, and each is packed.  Of a group of near copies (0.80 of the shingles in common) the smallest
doc_id stays.  Without labels no document is toxic, without benchmark items none is contaminated, and without documents
nothing comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itemflow.llm.common import materialize, table
from itemflow.llm.decontaminate import decontaminate
from itemflow.llm.near_dedup import without_near_copies
from itemflow.llm.packing import pack
from itemflow.llm.pii import redact
from itemflow.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, fill=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]

#: SQL expresses neither the fitted model, the graph rounds nor the ids of the tokenizer; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
