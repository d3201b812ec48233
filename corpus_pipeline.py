"""A corpus from raw documents to token files, in five stages.

Each stage reads what the one before has kept, as Parquet. All but the last
return the columns of documents:

1. quality rules: documents that the base rules or the learned list reject go;
2. near duplicates: one document of each group of linked ones stays;
3. benchmark decontamination: documents that contain a benchmark item go;
4. mixing: sources are brought to their target weights, repeats included;
5. token files: ids in directly addressable codes; one row a document, read back from them.

A repeat that stage 4 makes is a row of its own in stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm.common import table
from hindcast.llm.decontamination import keep_clean
from hindcast.llm.mixing import mix
from hindcast.llm.quality import keep_good
from hindcast.llm.similar import keep_one
from hindcast.llm.tokens import read_tokens, write_tokens
from hindcast.session import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_files),
]

#: Learned rules and tokenizers have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
