"""From raw documents to packed training sequences, one written table per stage.

Every stage takes all that its predecessor kept and returns the columns of
``documents``; the last one returns the pieces of the packed sequences.

1. quality       documents that the quality rules reject go
2. near_dedup    one document of each near-duplicate group stays (5-word shingles, similarity 0.8)
3. decontaminate passages of benchmark items are cut out of the texts
4. secrets       secrets become ``[SECRET]``
5. pack          texts become sequences of 1024 tokens

Defined results, in each stage: a null, empty or blank text is rejected by
``quality``, and passes all other stages as it is (``pack`` gives it its end
id); a null doc_id is kept and linked with nothing; texts of any length are
read whole; of rows that are equal in doc_id and text ``near_dedup`` keeps
one, rows of one doc_id with different texts stay apart; an empty table gives
an empty one; other columns pass through, whatever their names, and
``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import decontaminate as _decontaminate
from textquarry.llm import neardup as _neardup
from textquarry.llm import packing as _packing
from textquarry.llm import quality as _quality
from textquarry.llm import secrets as _secrets
from textquarry.llm.common import scratch, table

#: SQL has no form for the Markov models, the tokenizer or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.remove_hits(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
