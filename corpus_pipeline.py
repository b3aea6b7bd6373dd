"""A training corpus from raw documents: quality rules, near-duplicate removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, whatever their names.

Rows: a null or empty text fails the quality rules, so later stages see none; should they, a null text counts as empty. Null and
repeated ids stay rows of their own until near_duplicates keeps one of each group, told by id and text. Null languages and
sources are leaves of their own. Very long texts count whole everywhere. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, mixing, quality, simhash
from quarry.llm.common import Workspace, table
from quarry.llm.queries import vocabulary

#: Nine tenths of the tokens that are left, each document once at most, at the usual weights.
MIX = mixing.Mix(budget=(9, 10), max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the latest policy: each is judged alone, so repeated rows all stay or all go."""
    return quality.keep(docs)


#: Bytes of texts that Python gets at once: rows are whole texts, and ten thousand of them (Spark's measure) may be 64 MB in each of an executor's tasks.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity 0.8 or more): the least id, nulls last, then the least digest."""
    spark.conf.set(*BATCH)
    return simhash.keep(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's budget, in the order of a hash of their id; rows of one id in a leaf go together."""
    return mixing.keep(spark, docs, MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, row by row."""
    spark.conf.set(*BATCH)
    return bpe.encode_decode(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: Near-duplicate groups are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.put(docs, name)
            if k:
                work.drop(before)
    return docs
