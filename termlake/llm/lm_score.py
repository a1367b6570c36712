"""Cross-entropy difference of two matched n-gram models.

One model is counted on the documents that a condition calls the target, the other
on all documents, the background. They are matched: the same tokens (characters,
white space as one space), the same vocabulary (every character of the corpus),
the same order and the same smoothing, interpolation with the next lower order by
Witten and Bell. A document's score is the mean over its tokens of the background's
loss less the target's, in bits: the higher, the more it reads like the target.

The counts are of whole texts and of all documents. A task counts what it reads,
so a frequent n-gram is a few rows of each task, and Spark adds the rows up. As all
texts are counted, every n-gram of a document has its two losses in one table. Up
to ``BROADCAST_GRAMS`` n-grams, counted first, the table is broadcast and documents
are scored where they are read; beyond it the n-grams of the documents are joined
with the table. Both ways give the same scores but for rounding.

A null text has no tokens: n_tokens 0 and null losses, as for an empty one. Rows
with the same id are scored one by one. Without a target document its model knows
nothing, and every character is as likely as another. An empty table gives an
empty result."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 4
#: Rows of 24 bytes in a task, so 24 MB at the most.
BROADCAST_GRAMS = 1_000_000
#: Characters that a task counts at a time.
CHUNK_CHARS = 2_000_000
#: Stands ORDER - 1 times before a text.
START = "\x02"
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
GRAMS = "gram string, background long, target long"


def points_of(text: str | None) -> np.ndarray:
    """Code points after the starts; white space runs are one space."""
    clean = START * (ORDER - 1) + _SPACES.sub(" ", text or "").strip(" ")
    return np.frombuffer(clean.encode("utf-32-le", "replace"), "<u4")


def hashes_of(points: np.ndarray) -> np.ndarray:
    """A hash of the n-gram that ends at each token, for points of one or more texts."""
    size = len(points) - ORDER + 1
    out = np.zeros(size, np.uint64)
    for k in range(ORDER):
        out = (out ^ points[k:k + size].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def grams_at(points: np.ndarray, at: np.ndarray) -> list[str]:
    """The n-grams that begin ``at`` these places, as strings."""
    text = points[at[:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [text[i:i + ORDER] for i in range(0, len(text), ORDER)]


def _distinct(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All points, the place of each different n-gram, and for each token its n-gram
    and its text."""
    points = np.concatenate(texts)
    lengths = np.array([len(x) for x in texts])
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), bool)  # n-grams do not cross from text to text
    inside[(ends[:, None] - np.arange(1, ORDER)).ravel()] = False
    at = np.flatnonzero(inside)
    _, first, which = np.unique(hashes_of(points)[at], return_index=True, return_inverse=True)
    return points, at[first], which, np.repeat(np.arange(len(texts)), lengths - ORDER + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, target, waiting = [], [], 0

    def counted():
        points, at, which, text = _distinct(texts)
        background = np.bincount(which, minlength=len(at))
        mine = np.bincount(which, np.array(target, float)[text], len(at)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(grams_at(points, at), pa.string()), pa.array(background.astype(np.int64)),
                                           pa.array(mine)], names=["gram", "background", "target"])

    for batch in batches:
        for text, is_target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            texts.append(points_of(text.as_py()))
            target.append(bool(is_target))
            waiting += len(texts[-1])
            if waiting > CHUNK_CHARS:
                yield counted()
                texts, target, waiting = [], [], 0
    if waiting > (ORDER - 1) * len(texts):
        yield counted()


def count_grams(docs: DataFrame, is_target, text_col: str = "text") -> DataFrame:
    """gram, background and target: how often each n-gram occurs in all documents and
    in those of the target. A written table."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(is_target, F.lit(False)).alias("is_target"))
    return written(rows.mapInArrow(_count, GRAMS).groupBy("gram").agg(
        F.sum("background").alias("background"), F.sum("target").alias("target")), "grams")


MODELS = ("background", "target")


def losses(grams: DataFrame) -> DataFrame:
    """gram, background_loss and target_loss, in bits, of every n-gram's last token
    after the others. Lower orders are sums over the highest."""
    def order(n):
        return grams.groupBy(F.expr(f"right(gram, {n})").alias("gram")).agg(*[F.sum(m).alias(m) for m in MODELS])

    one = order(1)
    whole = one.agg(F.count(F.lit(1)).alias("v"), *[F.sum(m).alias(m) for m in MODELS]).first()
    p = one.select("gram", *[((F.col(m) + 1) / F.lit(float((whole[m] or 0) + whole["v"] or 1))).alias(f"p_{m}") for m in MODELS])
    for n in range(2, ORDER + 1):
        own = (grams if n == ORDER else order(n)).withColumns(
            {"context": F.expr(f"left(gram, {n - 1})"), "suffix": F.expr(f"right(gram, {n - 1})")})
        context = own.groupBy("context").agg(*[F.sum(m).alias(f"all_{m}") for m in MODELS],
                                             *[F.count_if(F.col(m) > 0).alias(f"kinds_{m}") for m in MODELS])
        lower = p.withColumnRenamed("gram", "suffix")

        def smoothed(m):
            seen = F.col(f"all_{m}") + F.col(f"kinds_{m}")
            return F.when(seen > 0, (F.col(m) + F.col(f"kinds_{m}") * F.col(f"p_{m}")) / seen).otherwise(F.col(f"p_{m}"))

        p = own.join(context, "context").join(lower, "suffix").select("gram", *[smoothed(m).alias(f"p_{m}") for m in MODELS])
    return written(p.select("gram", *[(-F.log2(f"p_{m}")).alias(f"{m}_loss") for m in MODELS]), "losses")


def _scored_here(docs: DataFrame, table: DataFrame) -> DataFrame:
    rows = table.toArrow()
    grams = "".join(rows.column("gram").to_pylist())
    points = np.frombuffer(grams.encode("utf-32-le", "replace"), "<u4")
    key = hashes_of(points)[::ORDER] if len(points) else np.zeros(0, np.uint64)
    order = np.argsort(key)
    value = np.stack([rows.column(f"{m}_loss").to_numpy() for m in MODELS], axis=1)[order]
    shared = docs.sparkSession.sparkContext.broadcast((key[order], value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = shared.value
        for batch in batches:
            count, sums = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(MODELS)))
            for i, text in enumerate(batch.column(1)):
                points = points_of(text.as_py())
                if len(points) >= ORDER:
                    count[i] = len(points) - ORDER + 1
                    sums[i] = value[np.searchsorted(key, hashes_of(points))].sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), *(pa.array(c) for c in np.ascontiguousarray(sums.T))],
                                             names=["doc_id", "n_tokens", *MODELS])
    return docs.mapInArrow(run, "doc_id long, n_tokens long, background double, target double")


def _scored_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
                points = points_of(text.as_py())
                if len(points) >= ORDER:
                    points, at, which, _ = _distinct([points])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(grams_at(points, at), pa.string()),
                                                      pa.array(np.bincount(which).astype(np.int64))], names=["row", "gram", "n"])

    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "scored-texts")
    sums = (rows.mapInArrow(run, "row long, gram string, n long").join(table, "gram").groupBy("row").agg(
        F.sum("n").alias("n_tokens"), *[F.sum(F.col("n") * F.col(f"{m}_loss")).alias(m) for m in MODELS]))
    return rows.select("doc_id", "row").join(sums, "row", "left").select(
        "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), *MODELS)


def cross_entropy_difference(docs: DataFrame, grams: DataFrame, broadcast_grams: int = BROADCAST_GRAMS,
                             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_tokens, background_loss, target_loss and score.
    ``grams`` are the counts of a corpus that holds all of ``docs``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table = losses(grams)
    scored = (_scored_here if table.count() <= broadcast_grams else _scored_by_join)(rows, table)
    mean = lambda m: F.when(F.col("n_tokens") > 0, F.col(m) / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", mean("background").alias("background_loss"), mean("target").alias("target_loss"),
                         (mean("background") - mean("target")).alias("score"))


def score_against_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs`` with the documents labelled good as the target. Labels grow
    with the documents, so both are merged by id at every size."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id", F.lit(True).alias("good")).distinct()
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left")
    return cross_entropy_difference(docs, count_grams(marked, F.col("good")))
