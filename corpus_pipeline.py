"""A corpus from documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is stored before the
next one reads it. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, mixing, substrings, toxicity
from tidemark.llm.store import matching, stored

#: Share of all tokens that mixing aims to keep.
BUDGET = 0.5
VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels beside the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return stored(toxicity.clean(docs, toxicity.fit(docs, labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays."""
    groups = jaccard.join(docs)
    gone = stored(groups.where("component_id <> doc_id").select("doc_id").distinct())
    return matching(docs, gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; n_chars follows the text."""
    return substrings.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to flatter source, language and topic margins, at half of the tokens."""
    found = mixing.measures(docs)
    mixed = mixing.mix(docs, mixing.even_targets(found), BUDGET, found=found)
    return mixed.where("_kept").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the decoded text."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("substring_dedup", cut_repeats),
          ("mixing", mix_sources), ("bpe", encode)]

#: Training a network and the graph stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
