"""From documents to packed training sequences, stage by stage.

Each stage is one operator on all that the stage before it kept, and stages hand
over Parquet tables in the shared folder:

1. language ID goes by the text alone; documents without a letter, and those for
   which no language gets ``MIN_SCORE``, go;
2. of documents with equal texts one stays;
3. of near-duplicates one stays;
4. sources are mixed to target weights along the curriculum, which repeats
   documents of small sources and leaves out some of large ones;
5. what the mix takes is packed into sequences, in its order, which the files of
   stage 4 hold: sequence numbers rise with the position in training.

Empty tables pass through every stage; null texts end at the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlake.llm import exact_dedup, langid, mixing, packing, simhash
from termlake.llm.common import in_file_order, written

#: With four languages a guess scores 0.25; a plain text of one language over 0.9.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = "__llm_lang", "__llm_score"
    found = langid.predict(docs, langid.train(docs), out=(lang, score))
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).drop(lang, score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(in_file_order(docs), packing.public_tokenizer())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix),
          ("packing", pack)]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
