"""Language identification by string kernels.

The kernel of two texts is the number of blended n-grams (1 to 3 characters, case
folded) that occur in both, over the root of the product of how many each has.
Landmark texts of every language span the Nyström space: the kernel of a text with
the landmarks, times the inverse root of the landmarks' own kernel matrix. In that
space one-versus-rest ridge regression gives each language a linear score. Texts
are scored a block at a time, as products of their presence matrix with the
landmarks' and with the weights.

The classifier is fitted on a sample of labelled rows: ``sample_rows`` different
texts of each language, less where languages are so many that they would be over
``all_rows``, but one at least. The sample is the texts with the lowest hash; a text
that many rows repeat is one of them. ``landmarks`` of each language are landmarks,
in turn, up to ``all_landmarks``. Every label is learned.

A text that is null or has no letter is ``und`` with score 0. Rows are judged one
by one, so repeated rows agree. Without any labelled row every text is ``und``. An
empty table gives an empty result."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
#: N-grams are numbered by a hash into this many slots; two in one slot count as one.
SLOTS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_ROWS, LANDMARKS, RIDGE, SHARPNESS = 300, 60, 1e-2, 6.0
ALL_ROWS, ALL_LANDMARKS = 20_000, 1_000
#: Texts scored in one matrix product, and characters of a text read at a time.
BLOCK_ROWS, CHUNK_CHARS = 64, 1 << 20


def grams(text: str) -> np.ndarray:
    """Which slots occur in ``text``, as 0 and 1."""
    present = np.zeros(SLOTS, np.uint8)
    for at in range(0, max(1, len(text)), CHUNK_CHARS):
        points = np.frombuffer(text[at:at + CHUNK_CHARS + max(ORDERS) - 1].lower().encode("utf-32-le", "replace"), np.uint32)
        code = np.zeros(len(points), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            code = code[:len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1:] + np.uint32(n)
            if n in ORDERS and len(code):
                mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                present[mixed >> np.uint32(32 - 16)] = 1
    return present


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Classifier:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x slots, 0 and 1
    sizes: np.ndarray  # root of the number of slots of each landmark
    weights: np.ndarray  # landmarks x languages

    def folded(self) -> list[np.ndarray]:
        """What a text's presence is multiplied with, one after the other: landmarks
        and weights, or their product where that is smaller."""
        factors = [self.landmarks.T.astype(np.float32), (self.weights / self.sizes[:, None]).astype(np.float32)]
        return factors if len(self.languages) > len(self.landmarks) else [factors[0] @ factors[1]]


def scores(present: np.ndarray, folded: list[np.ndarray]) -> np.ndarray:
    own = np.sqrt(np.maximum(present.sum(axis=1, dtype=np.float64), 1))
    out = present.astype(np.float32)
    for factor in folded:
        out = out @ factor
    return out.astype(np.float64) / own[:, None]


def fit(languages: list[str], labels: np.ndarray, packed: np.ndarray, landmarks: int = LANDMARKS,
        ridge: float = RIDGE, all_landmarks: int = ALL_LANDMARKS) -> Classifier:
    """Fits to a sample: ``labels`` index ``languages``, ``packed`` has its rows'
    presence as bits, of which a block at a time is unpacked."""
    root = lambda x: np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1))
    turn = np.zeros(len(labels), np.int64)  # how many rows of the same language come before
    for k in range(len(languages)):
        own = np.flatnonzero(labels == k)
        turn[own] = np.arange(len(own))
    chosen = np.lexsort((labels, turn))
    chosen = np.sort(chosen[turn[chosen] < landmarks][:all_landmarks])
    marks = np.unpackbits(packed[chosen], axis=1).astype(np.float32)
    among = (marks @ marks.T).astype(np.float64) / root(marks)[:, None] / root(marks)
    values, vectors = np.linalg.eigh(among)
    solid = values > values[-1] * 1e-6
    inverse_root = vectors[:, solid] / np.sqrt(values[solid])
    common = np.concatenate([x @ marks.T / root(x)[:, None] for i in range(0, len(packed), BLOCK_ROWS)
                             for x in [np.unpackbits(packed[i:i + BLOCK_ROWS], axis=1).astype(np.float32)]])
    features = common / root(marks) @ inverse_root
    # every language weighs the same, however many rows it has
    weight = 1.0 / np.bincount(labels, minlength=len(languages))[labels]
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    system = features.T @ (features * weight[:, None]) + ridge * len(languages) / len(labels) * np.eye(features.shape[1])
    weights = inverse_root @ np.linalg.solve(system, features.T @ (target * weight[:, None]))
    return Classifier(languages, marks.astype(np.uint8), root(marks), weights)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, all_rows: int = ALL_ROWS,
          landmarks: int = LANDMARKS, text_col: str = "text", lang_col: str = "lang") -> Classifier | None:
    """Learns from the rows of ``docs`` whose language is not null. The driver gets
    the slots of the sample."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("order"))
    rows = rows.filter("lang is not null and text is not null")
    counts = written(rows.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")), "languages")
    n_languages = counts.count()
    if not n_languages:
        return None
    sample_rows = max(1, min(sample_rows, all_rows // n_languages))
    # more than twice the share that gives the sample, by hash, leaves few texts to order
    part = F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53))
    near = rows.join(counts.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"))
    near = near.filter(part * F.col("n") <= F.lit(2.0 * sample_rows + 64)).groupBy("lang", "order").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("order", 1))
    sample = near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.packbits(grams(x.as_py())).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(slots, pa.binary())],
                                             names=["lang", "k", "slots"])

    got = sample.select("lang", "text", "k").mapInArrow(run, "lang string, k int, slots binary").collect()
    got.sort(key=lambda r: (r["lang"], r["k"]))
    languages = sorted({r["lang"] for r in got})
    number = {x: i for i, x in enumerate(languages)}
    labels = np.array([number[r["lang"]] for r in got])
    packed = np.frombuffer(b"".join(bytes(r["slots"]) for r in got), np.uint8).reshape(len(got), SLOTS // 8)
    return fit(languages, labels, packed, landmarks)


def predict(docs: DataFrame, model: Classifier | None, text_col: str = "text", keep_text: bool = True,
            sharpness: float = SHARPNESS, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs``, without its text unless ``keep_text``, with the language and its score
    (a softmax of the scores) as the columns ``out``; columns of ``docs`` that have
    these names are replaced. Only the text is looked at."""
    keep = [c for c in docs.columns if c not in out and (keep_text or c != text_col)]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    kept = len(keep)
    text_at = keep.index(text_col) if text_col in keep else kept
    if text_at == kept:
        inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                            F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.folded()))  # slots x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(text_at)
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for at in range(0, len(texts), BLOCK_ROWS):
                block = [(i, x) for i in range(at, min(at + BLOCK_ROWS, len(texts)))
                         if model and (x := texts[i].as_py()) is not None and has_letter(x)]
                if block:
                    languages, folded = model
                    raw = scores(np.stack([grams(x) for _, x in block]), folded)
                    power = np.exp(sharpness * (raw - raw.max(axis=1, keepdims=True)))
                    best = raw.argmax(axis=1)
                    for (i, _), k, p in zip(block, best, 1 / power.sum(axis=1), strict=True):
                        lang[i], score[i] = languages[k], p
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(lang, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names[:kept], "lang_pred", "score"])

    schema = inner.select(*inner.columns[:kept]).schema.add("lang_pred", "string").add("score", "double")
    found = inner.mapInArrow(run, schema)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("lang_pred").alias(out[0]),
                        F.col("score").alias(out[1]))
