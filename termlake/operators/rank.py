"""BM25 and the sums that combine conditions into one score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conditions import Group, Leaf

K1, B = 1.2, 0.75  # fixed values
SCORE_DIGITS = 6


@dataclass(frozen=True)
class FieldStats:
    """Documents and their mean length in tokens, for one field."""
    n_docs: int
    avgdl: float


def idf(n_docs: int, df: int) -> float:
    return log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, dl: Column, weight: Column | float, avgdl: Column | float) -> Column:
    """Score of ``tf`` occurrences in a field of ``dl`` tokens; ``weight`` is the
    idf of the term, or the sum of the idfs of a phrase's terms."""
    weight, avgdl = (x if isinstance(x, Column) else F.lit(float(x)) for x in (weight, avgdl))
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def group_flag(group: Group, hit: dict[Leaf, Column]) -> Column:
    return reduce(lambda a, b: a & b, (hit[l] if req else ~hit[l] for l, req in group))


def combine(groups: list[Group], hit: dict[Leaf, Column], score: dict[Leaf, Column]):
    """(matched, score): a group that did not match adds nothing, an excluded
    condition adds nothing."""
    flags = [group_flag(g, hit) for g in groups]
    sums = [reduce(lambda a, b: a + b, (score[l] for l, req in g if req)) for g in groups]
    total = reduce(lambda a, b: a + b,
                   (F.when(f, s).otherwise(F.lit(0.0)) for f, s in zip(flags, sums)))
    return reduce(lambda a, b: a | b, flags), total


def top_k(matches: DataFrame, limit: int, tie_cols=("path",)) -> DataFrame:
    """Best ``limit`` rows, ties by key. Scores are rounded before the cut so that
    the order in which floating-point sums ran cannot move the boundary. Plans
    a per-partition top-k, never a full sort."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return (matches.withColumn("score", F.round("score", SCORE_DIGITS))
            .orderBy(F.desc("score"), *tie_cols).limit(limit))
