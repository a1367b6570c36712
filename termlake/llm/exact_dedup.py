"""Exact deduplication against a minimal perfect hash of historical digests.

Texts are equal when they are the same without white space; a text's digest is
the SHA-256 of that. The history is a table of distinct digests. Its buckets are
hashed minimally and perfectly: bucket by bucket a cascade of bit arrays gives
each digest a slot of its own, and the slot holds the full digest and where the
best row with it is. A new digest is looked up in its slot and compared byte by
byte: members are repeats of the history, the others are grouped among
themselves. Rows are counted per digest before anything is shuffled, so a text
that a third of all rows share is one row of the lookup.

Null texts count as empty. Of rows with equal texts the one with the longest
original stays, then the smallest doc_id (null last), then one of the rows that
agree in both. An empty table gives an empty result."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_lookup, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Distinct digests in a bucket of the index, on average.
BUCKET_DIGESTS = 100_000
#: Bits of a level for each digest that the level has to place.
GAMMA = 2.0
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)

#: What a slot holds besides the digest: the best row and the number of rows.
WINNER = {"chars": "long", "id": "long", "no_id": "boolean", "row": "long", "size": "long"}
INDEX_SCHEMA = ", ".join(["bucket long", "levels array<binary>", "digests binary",
                          *(f"{name} array<{kind}>" for name, kind in WINNER.items())])
FOUND_SCHEMA = ", ".join(["digest binary", *(f"{name} {kind}" for name, kind in WINNER.items()), "historical boolean"])


# --- the hash function -------------------------------------------------------

def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8").reshape(len(digests), 4)
    return words[:, 0], words[:, 1]


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a + b * np.uint64(2 * level + 1)
        for m in _MIX:
            x = (x ^ (x >> np.uint64(29))) * np.uint64(m)
        return ((x >> np.uint64(11)) % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one per level: a digest that has a bit of the level to itself
    is placed there, the others go on to the next level. ``digests`` is n x 32
    bytes, all different."""
    a, b = _halves(digests)
    levels = []
    while len(a):
        size = max(8, -(-int(len(a) * GAMMA) // 8) * 8)
        at = _place(a, b, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        left = ~alone[at]
        a, b = a[left], b[left]
    return levels


def slots_of(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot of every digest of the history; for others any slot or -1."""
    a, b = _halves(digests)
    slot, open_, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    for level, packed in enumerate(levels):
        bits = np.unpackbits(packed, bitorder="little")
        rank = np.cumsum(bits, dtype=np.int64)
        at = _place(a[open_], b[open_], level, len(bits))
        hit = bits[at] == 1
        slot[open_[hit]] = base + rank[at[hit]] - 1
        open_, base = open_[~hit], base + int(rank[-1])
    return slot


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


# --- tables --------------------------------------------------------------------

def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest and code points of every row, and a row number that stands
    for the row: a written table."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return written(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), digest(text).alias("digest"),
                               F.char_length(text).cast("long").alias("n_chars"))
                   .withColumn("row", F.monotonically_increasing_id()), "digests")


def digest(text):
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", "").cast("binary"), 256))


def best_per_digest(rows: DataFrame) -> DataFrame:
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row"))
    return rows.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("size")).select(
        "digest", "size", (-F.col("b.col1")).alias("chars"), F.coalesce("b.doc_id", F.lit(0)).alias("id"),
        F.col("b.doc_id").isNull().alias("no_id"), F.col("b.row").alias("row"))


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def _build(group: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(group["digest"])
    levels = build_hash(digests)
    order = np.argsort(slots_of(levels, digests))
    one = {name: group[name].to_numpy()[order].tolist() for name in WINNER}
    return pd.DataFrame([{"bucket": int(group["bucket"].iloc[0]), "levels": [x.tobytes() for x in levels],
                          "digests": digests[order].tobytes(), **one}])


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index of the distinct digests in ``history`` (as of ``digest_rows``):
    one row per bucket. A written table, which later batches can be held against."""
    best = _bucketed(best_per_digest(history), buckets)
    return written(best.groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA), "digest-index")


def _probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Merges one bucket's new digests into its slots."""
    keys, parts = _matrix(new["digest"]), []
    fresh = {name: new[name].to_numpy() for name in WINNER}
    member = np.zeros(len(new), bool)
    if len(index):
        one = index.iloc[0]
        held = _matrix([one["digests"]])
        slot = slots_of([np.frombuffer(x, np.uint8) for x in one["levels"]], keys)
        member = (slot >= 0) & (held[slot] == keys).all(axis=1)
        at = slot[member]
        old = {name: np.array(one[name]) for name in WINNER}
        mine = {name: x[member] for name, x in fresh.items()}
        old["size"][at] += mine["size"]
        same_length, same_null = mine["chars"] == old["chars"][at], mine["no_id"] == old["no_id"][at]
        wins = (mine["chars"] > old["chars"][at]) | (
            same_length & ((mine["no_id"] < old["no_id"][at]) | (same_null & (mine["id"] < old["id"][at]))))
        for name in ("id", "no_id", "row"):
            old[name][at[wins]] = mine[name][wins]
        parts.append(pd.DataFrame({"digest": [x.tobytes() for x in held], **old, "historical": True}))
    rest = ~member
    parts.append(pd.DataFrame({"digest": new["digest"].to_numpy()[rest],
                               **{name: x[rest] for name, x in fresh.items()}, "historical": False}))
    return pd.concat(parts)[["digest", *WINNER, "historical"]]


def look_up(index: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """One row per digest of the history or of ``new``: the row that stays, the
    number of rows and whether the history has it."""
    best = _bucketed(best_per_digest(new), buckets)
    return best.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_probe, FOUND_SCHEMA).select(
        "digest", F.col("row").alias("keep_row"), F.when(~F.col("no_id"), F.col("id")).alias("keep_id"),
        F.col("size").alias("group_size"), "historical")


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_DIGESTS))


def exact_dedup(docs: DataFrame, is_history=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, digest, n_chars, keep_id, group_size, kept, and
    ``historical``, whether its text was in the history. ``is_history`` is a
    condition on doc_id that says which rows came first; by default those whose
    doc_id has an even crc32, so that half of a table is held against the other."""
    rows = digest_rows(docs, id_col, text_col)
    if is_history is None:
        is_history = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    old = F.coalesce(is_history, F.lit(False))
    total = rows.count()
    buckets = buckets_for(total)
    index = build_index(rows.filter(old), buckets)
    found = written(look_up(index, rows.filter(~old), buckets), "digests-found")
    return join_lookup(rows, found, "digest", "group_size", total).select(
        "doc_id", "digest", "n_chars", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        "historical")


def keep_first(docs: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, **columns).filter("kept").select(
        F.col("doc_id").alias("__llm_id"), F.col("digest").alias("__llm_digest"), F.col("n_chars").alias("__llm_chars"))
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.withColumns({"__llm_key": digest(text), "__llm_length": F.char_length(text).cast("long")})
    same = ((F.col("__llm_key") == F.col("__llm_digest")) & (F.col("__llm_length") == F.col("__llm_chars"))
            & F.col(f"`{id_col}`").eqNullSafe(F.col("__llm_id")))
    return own.join(kept, same, "left_semi").dropDuplicates(["__llm_key", "__llm_length"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
