"""The stages of the corpus pipeline, each against what it stands for."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from termlake.llm import langid, mixing, packing
from termlake.llm.common import written

from .test_operators import SCHEMA, WORD, fingerprint_of, odd_rows, roots_of

norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_stages(spark, sf_dir, table):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120) if table == "documents" else spark.createDataFrame(odd_rows(), SCHEMA)
    docs = written(docs, "in")
    columns = docs.columns
    texts = lambda d: [r.text for r in d.collect()]

    first = written(corpus_pipeline.language_id(spark, docs, sf_dir), "s1")
    plain = [t for t in texts(docs) if t is not None and langid.has_letter(t)]
    assert not collections.Counter(texts(first)) - collections.Counter(plain) and first.columns == columns
    assert first.count() >= 0.98 * len(plain) if table == "documents" else first.count() > 0

    second = written(corpus_pipeline.exact(spark, first, sf_dir), "s2")
    assert sorted(map(norm, texts(second))) == sorted(set(map(norm, texts(first)))) and second.columns == columns

    third = written(corpus_pipeline.near(spark, second, sf_dir), "s3")
    prints = [fingerprint_of(t) for t in texts(second)]
    of = dict(zip(texts(second), roots_of(prints)))
    assert sorted(of[t] for t in texts(third)) == sorted(set(of.values())) and third.columns == columns

    fourth = written(corpus_pipeline.mix(spark, third, sf_dir), "s4")
    plan = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    assert collections.Counter(r.doc_id for r in fourth.collect()) == collections.Counter({k: n for k, n in plan.items() if n})
    assert fourth.columns == columns
    words = lambda d: sum(len(WORD.findall(t)) for t in texts(d))
    largest = collections.Counter()  # documents are taken whole, so a source misses its target by one at most
    for r in third.collect():
        largest[r.source] = max(largest[r.source], len(WORD.findall(r.text)))
    assert words(fourth) == pytest.approx(1.5 * words(third), abs=sum(largest.values()))

    fifth = corpus_pipeline.pack(spark, fourth, sf_dir).toPandas()
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(packing.public_tokenizer())
    want = collections.Counter()
    for r in fourth.collect():
        want[zlib.crc32(np.array([*coder.encode(r.text).ids, 1], "<u4").tobytes()), r.doc_id] += 1
    whole = fifth[fifth.length == fifth.doc_tokens]
    assert not collections.Counter(zip(whole.ids_crc32, whole.doc_id)) - want
    assert (fifth.groupby("sequence_id").length.sum() <= 2048).all()
    assert fifth.length.sum() == sum(len(coder.encode(r.text).ids) + 1 for r in fourth.collect())


def test_sequences_follow_the_training_order(spark, sf_dir):
    """Over many files, which a reader deals out by size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6)
    docs = written(docs, "order-in")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = written(corpus_pipeline.mix(spark, docs, sf_dir), "order-mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 1
    once = {r.doc_id: r.positions[0] for r in mixing.mix(docs).filter("copies = 1").collect()}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        packed = corpus_pipeline.pack(spark, mixed, sf_dir).orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    seen = [once[r.doc_id] for r in packed if r.start == 0 and r.doc_id in once]
    assert len(seen) > 50 and seen == sorted(seen)


def test_empty_tables_pass(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "none")
        assert docs.count() == 0


def test_run_is_the_stages_in_turn(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "ids_crc32" in out.columns
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumn("tags", F.create_map(F.lit("a"), F.col("source")))
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "mapped")
    assert docs.count() > 0
