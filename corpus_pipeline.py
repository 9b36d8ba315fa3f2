"""From raw documents to packed sequences, stage by stage.

Each stage takes what the one before it kept, as a table, and all but the last return the columns of documents:
language identification drops texts without a language, toxicity those predicted toxic, the Jaccard join all but the
smallest id of each group of near copies; mixing takes each source's documents as often as its target asks; packing returns
the pieces of all documents with their places. Only bounded models and tables of one row a source are sent to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditspark.llm.common import cut, table
from auditspark.llm.jaccard import keep_one
from auditspark.llm.langid import keep_identified
from auditspark.llm.mixing import take_mix
from auditspark.llm.packing import pack_documents
from auditspark.llm.toxicity import keep_civil


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("language ID", language), ("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("mixing", mixing), ("packing", packing)]

#: Trained models and the tokenizer can't be written in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
