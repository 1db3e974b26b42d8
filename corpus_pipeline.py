"""The corpus pipeline: documents go through STAGES one after another.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; its result is written
as Parquet in the shared folder and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millwright.llm import decontam, mixing, near_copies, token_store, toxicity
from millwright.llm.common import fresh_path, table

#: Poor text is thinned to a quarter of its tokens; the others' targets lie above what they have, and the
#: rate of 1 that caps them keeps them whole.  Toxic text is gone by then, so what is left of it isn't thinned.
MIX_TARGETS = {"clean": 1.05, "toxic": 1.05, "poor": 0.25}

NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the limit go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: five-word shingles, Jaccard similarity 0.8."""
    return near_copies.near_dedup(docs, NEAR_SHINGLE, NEAR_SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly benchmark goes."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poor text is thinned towards its target share."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), MIX_TARGETS, max_rate=1.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents: doc_id, start, n_tokens, ids_crc32."""
    return token_store.op10(docs, cache_pieces=100_000)  # workers hold other stages' memory too


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("tokens", tokenize)]
#: SQL can't express the grammar, the automaton or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
