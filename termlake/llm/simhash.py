"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most d bits,
they differ in at most d // segments bits in one segment at least. So every
fingerprint stands in one table per segment, and looks up the values of a small
Hamming ball around each of its own segments; of two different values the larger
looks the smaller up, which halves the ball. Whoever meets in a table entry is
compared over all 64 bits. Equal fingerprints are one row from the start.

The rows of an entry are compared in blocks of arrays, and what is handed on is
not their links but a forest that connects the same fingerprints, so the output
stays linear however dense a group is. Entries with more than ``BLOCK`` fingerprints
are dealt to several tasks as pairs of blocks, so every pair is still compared.

A null or empty text has no words and the fingerprint zero, linked like any other.
Rows with the same id or text are rows of their own. A null id counts after all
others and gives a null component only where no id is known. An empty table gives
an empty result."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_lookup, row_key, written
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of a table entry that one task compares.
BLOCK = 4096
#: Rows that a linking task gathers before it compares them, and pairs at a time.
GATHER_ROWS, PAIRS = 200_000, 1_000_000


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle_words, len(words))
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:])], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, row_key, fp and a row number of every document: a written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(x.as_py(), shingle_words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())],
                                             names=["doc_id", "row_key", "fp"])
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_key(docs).alias("row_key"),
                        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return written(texts.mapInArrow(run, "doc_id long, row_key long, fp long")
                   .withColumn("row", F.monotonically_increasing_id()), "fingerprints")


# --- tables and balls -----------------------------------------------------------

def segments_for(distinct: int) -> int:
    """Fewer, longer segments for more fingerprints: an entry of 21 bits would hold
    too many. The links found are the same."""
    return 3 if distinct <= 1 << 25 else 2


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment."""
    widths = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _ball(bits: int, radius: int) -> np.ndarray:
    masks = [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]
    return np.array(masks, np.int64)


def _entries(segments: int, max_bits: int):
    """Table rows and probes: (entry, fp, probe), the entry being a segment's number
    and a value of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy()
            for at in range(0, len(all_fp), 2048):
                fp = all_fp[at:at + 2048]
                for i, (shift, bits) in enumerate(_cuts(segments)):
                    own = (fp.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
                    ball = own[:, None] ^ _ball(bits, max_bits // segments)[None, :]
                    who, which = np.nonzero(ball < own[:, None])
                    entry = np.concatenate([own, ball[who, which]]) + (i << 40)
                    probe = np.zeros(len(entry), bool)
                    probe[len(own):] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(entry), pa.array(np.concatenate([fp, fp[who]])), pa.array(probe)],
                        names=["entry", "fp", "probe"])
    return run


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest_by_search(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in ``fp``: whoever is reached is compared
    no more, so a dense group costs little."""
    left, a, b, frontier = fp, [], [], []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        one = frontier.pop()
        near = _far(left, one) <= max_bits
        if near.any():
            found = left[near]
            a.append(np.full(len(found), one))
            b.append(found)
            frontier.extend(found)
            left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _thin(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each fingerprint that ``a`` and ``b`` link, with the
    same components."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[:len(a)], at[len(a):], np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _compare(entry: np.ndarray, fp: np.ndarray, probe: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole entries, sorted by entry with table rows first."""
    edge = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    size = np.diff(np.r_[edge, len(entry)])
    held = np.add.reduceat(~probe, edge)
    a, b = [], []
    large = size * held > BLOCK
    for k in np.flatnonzero(large):
        part = _forest_by_search(fp[edge[k]:edge[k] + size[k]], max_bits)
        a.append(part[0])
        b.append(part[1])
    end = np.repeat(edge + size, size)
    todo = np.flatnonzero(~probe & ~np.repeat(large, size))
    count = end[todo] - todo - 1
    todo, count = todo[count > 0], count[count > 0]
    cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, count.sum() + PAIRS, PAIRS))
    for i, j in zip(np.r_[0, cuts + 1], np.minimum(cuts + 1, len(todo)), strict=False):
        if i >= j:
            continue
        n = count[i:j]
        left = np.repeat(todo[i:j], n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = _far(fp[left], fp[right]) <= max_bits
        a.append(fp[left[near]])
        b.append(fp[right[near]])
    none = np.zeros(0, np.int64)
    return _thin(np.concatenate([none, *a]), np.concatenate([none, *b]))


def _linker(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def compared(whole: bool):
            nonlocal parts, rows
            entry, fp, probe = (np.concatenate([p[i] for p in parts]) for i in range(3))
            stop = len(entry) if whole else int(np.searchsorted(entry, entry[-1]))
            parts, rows = [(entry[stop:], fp[stop:], probe[stop:])], len(entry) - stop
            if stop:
                a, b = _compare(entry[:stop], fp[:stop], probe[:stop], max_bits)
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            parts.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            rows += batch.num_rows
            if rows >= GATHER_ROWS and (out := compared(False)) is not None:
                yield out
        if rows and (out := compared(True)) is not None:
            yield out
    return run


def _dealt(rows: DataFrame, distinct: DataFrame, segments: int) -> DataFrame:
    """Rows of entries with over BLOCK table rows, copied to each pair of blocks
    that they belong to, under the pair's number."""
    own = [F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1) + F.lit(i << 40)
           for i, (shift, bits) in enumerate(_cuts(segments))]
    crowded = written(distinct.select(F.explode(F.array(*own)).alias("entry")).groupBy("entry")
                      .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "crowded")
    if crowded.isEmpty():
        return rows.withColumn("pair", F.lit(0).cast("long"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    block = F.pmod(F.xxhash64("fp"), blocks)
    others = F.sequence(F.lit(0).cast("long"), blocks - 1)
    pairs = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).when(
        F.col("probe"), F.transform(others, lambda j: j * blocks + j)).otherwise(
        F.transform(others, lambda j: F.least(block, j) * blocks + F.greatest(block, j)))
    return rows.join(crowded, "entry", "left").select("entry", F.explode(pairs).alias("pair"), "fp", "probe")


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """Links (a, b) that connect the fingerprints in column ``fp``, all different,
    exactly as all pairs with at most ``max_bits`` differing bits would."""
    segments = segments or segments_for(distinct.count())
    rows = distinct.select("fp").mapInArrow(_entries(segments, max_bits), "entry long, fp long, probe boolean")
    rows = _dealt(rows, distinct, segments)
    # one number for entry and pair, so that whole groups are neighbours when sorted
    rows = rows.select((F.col("entry") + F.shiftleft("pair", 44)).alias("entry"), "fp", "probe")
    sorted_rows = rows.repartition("entry").sortWithinPartitions("entry", "probe")
    return sorted_rows.mapInArrow(_linker(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, row_key, fp, component_id, and kept, true for one
    row of each component: the one with the smallest id."""
    rows = fingerprints(docs, shingle_words, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    distinct = written(rows.groupBy("fp").agg(first, F.count(F.lit(1)).alias("n")), "distinct-fp")
    roots = components(links(distinct, max_bits))
    owned = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = owned.groupBy("root").agg(F.min("first").alias("least"))
    named = written(owned.join(least, "root").select(
        "fp", "n", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keep_row")), "components")
    total = rows.count()
    return join_lookup(rows, named, "fp", "n", total).select(
        "doc_id", "row_key", "fp", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all columns."""
    kept = near_duplicates(docs, id_col=id_col, **parameters).filter("kept").select(
        F.col("doc_id").alias("__llm_id"), F.col("row_key").alias("__llm_row"))
    own = docs.withColumn("__llm_key", row_key(docs))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_key") == F.col("__llm_row"))
    return own.join(kept, same, "left_semi").dropDuplicates([id_col, "__llm_key"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
