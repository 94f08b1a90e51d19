"""From documents to token files: toxic documents go, one of each group of near
copies stays, documents that hold benchmark passages go, sources are mixed and
the mixture is encoded.

Each stage works on all that its predecessor kept, and is written and read
again in between, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.llm import decontaminate, mixing, simhash_dedup, token_files, toxicity
from stratalith.llm.keys import scratch, table

#: Passes over the most repeated source; the least repeated one is passed over once, so no document is lost to mixing.
MAX_REPEATS = 2.0


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_words=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realise(docs, mixing.mix(docs, max_repeats=MAX_REPEATS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.encode_documents(spark, docs))


STAGES = [("toxicity", reject_toxic), ("simhash_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("source_mixing", mix_sources), ("token_files", encode)]

#: Trained fields, XXH64, random walks and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
