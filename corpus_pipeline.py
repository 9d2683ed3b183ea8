"""From raw documents to token ids in five stages; every stage is written as Parquet and read again by the next.

quality rules -> MinHash near-dedup -> substring dedup -> mixing to target weights -> BPE.

Defined cases, for all stages: rows are told apart by doc_id and text, so rows of null id and several texts of one id are
documents like others; null and empty texts fail the base rule and go in the first stage; very long texts are handled whole;
of rows equal in doc_id and text one stays in the second stage; ties go to the smallest doc_id; empty tables give empty
tables; extra columns, whatever their names, are carried to the last stage, which returns ids instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from moundworks.llm import bpe, mixing, near_dedup, quality_rules, substring
from moundworks.llm.common import drop, read_table, scratch_dir
from moundworks.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(spark, docs, read_table(spark, sf_dir, "labels"))


#: Words of a shingle in the near-dedup stage: op5's own; test_pipeline.py holds the stage to it.
NEAR_WIDTH = 2


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.keep_one(spark, docs, NEAR_WIDTH)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages are cut out; a document of which nothing is left goes."""
    return substring.without_repeats(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies are rows of their own."""
    return mixing.apply_mix(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row, with their number and the text that they give back."""
    return bpe.encode_rows(spark, docs, vocabulary_path())


STAGES = [("quality rules", quality), ("near dedup", near), ("substring dedup", repeats), ("mixing", mix), ("bpe", tokens)]

#: Random draws, suffix automata and BPE have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's table goes as soon as its successor's is written; the result reads the last one."""
    docs, path = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        out, before, path = stage(spark, docs, sf_dir), path, f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
