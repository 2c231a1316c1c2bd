"""A training corpus in five stages over ``documents``.

1. language ID: documents without a language (no text, no letter) go;
2. exact dedup: one row of each group of equal texts stays;
3. n-gram Jaccard join: one document of each class of near copies stays;
4. mixing: the documents in Pfair order of their sources, those of sources that
   their weight asks more of than they have once more from the start;
5. byte-level BPE: the ids of every text, checked by decoding them.

Every stage's rows are written to the shared folder and read again by the next.
All but the last return the columns of ``documents`` (and whatever others there
are) unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefixdex.llm import bpe, exact_dedup, jaccard_join, langid, mixing, queries, tables
from prefixdex.plans.session import ensure_checkpoint_dir


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, queries.learned_languages(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, *queries.tokenizer())


STAGES = [
    ("language ID", keep_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Mixture inference, sketches of sets and BPE merges are not SQL; the pipeline is
#: held against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
