"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the shared
folder and reads it again for the next. All stages but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.mixing import KEPT_TOKENS, mixture
from tidemark.llm.packing import retrieval_packing
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.substring import remove_repeats
from tidemark.llm.toxicity import toxicity
from tidemark.session import materialise


def _without(docs: DataFrame, ids: DataFrame, same: Column) -> DataFrame:
    """Documents whose id is not listed; where the list is too long to broadcast, it is hashed and the texts are not sorted."""
    return docs.join(materialise(ids).hint("shuffle_hash"), same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    toxic = toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(F.col("doc_id").alias("_toxic")).distinct()
    return _without(docs, toxic, F.col("doc_id") == F.col("_toxic"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each SimHash group; a document without an id stays."""
    groups = simhash_groups(docs)
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return _without(docs, copies, F.col("doc_id") == F.col("_copy"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    cleaned = remove_repeats(docs, whole_rows=True).select("row.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics; a document without an id stays."""
    left = mixture(docs, size=KEPT_TOKENS).where("not selected").select(F.col("doc_id").alias("_left")).distinct()
    return _without(docs, left, F.col("doc_id") == F.col("_left"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences."""
    return retrieval_packing(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_per_group),
    ("substring_dedup", without_repeats),
    ("source_mixture", mixed),
    ("retrieval_packing", packed),
]

#: Models, hashes and packing are not for SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
