"""Removal of repeated passages by relative Lempel-Ziv parsing.

The reference of a document is all that stands earlier: smaller ids, and its own
words further left. The reference is indexed in blocks by hash, and a block holds
for each window of 20 words the place where it first occurs. A document is parsed
greedily against all blocks: where a window is not its own first place a factor
starts, which goes on for as long as the following windows have earlier places, so
it is the longest there is. A factor has 20 words at least. Windows that cross the
end of a factor are looked up like any other, so the next factor may begin inside
the last one, and what the factors cover is what repeats.

Most windows occur once, and they are never shuffled. Each window has an anchor,
the five-word sequence in it with the least hash, and neighbours mostly share one.
A window whose anchor occurs once in all documents occurs once; only the others
are looked up. Anchors and windows are combined before each shuffle, so a passage
that every document has is a few rows of each task.

Windows are compared by 96 bits of hash. A null text has no words. Rows that share
an id, and null ids, which come last, are told apart by a hash of the text; equal
rows count as earlier and later ones. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, ANCHOR_WORDS = 20, 5
#: Anchors that a task combines at a time, and windows.
COMBINED_ROWS = 1_000_000
_BASE, _BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


def _rolled(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words, by doubling."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, have, power, part, length = None, 0, 1, words, 1
    rest = n
    while rest:
        if rest & 1:
            if out is None:
                out, have = part, length
            else:
                size = min(len(out), len(part) - have)
                out = out[:size] + part[have:have + size] * np.uint64(pow(base, have, 1 << 64))
                have += length
        rest >>= 1
        if rest:
            part = part[:len(part) - length] + part[length:] * np.uint64(pow(base, length, 1 << 64))
            length *= 2
    return _mixed(out[:len(words) - n + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _along(x: np.ndarray, n: int, least) -> np.ndarray:
    """The least (or greatest) of every ``n`` neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = least(x[:len(x) - step], x[step:])
        have += step
    return x


def window_anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every anchor sequence, and the anchor hash of every window."""
    if len(words) < window:
        none = np.zeros(0, np.uint64)
        return none, none
    hashes = _rolled(words, ANCHOR_WORDS, _BASE_2)
    return hashes, _along(hashes, window - ANCHOR_WORDS + 1, np.minimum)


def anchors_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where anchors are, and their hashes."""
    hashes, of_window = window_anchors(words, window)
    if not len(of_window):
        return np.zeros(0, np.int64), hashes
    reach = window - ANCHOR_WORDS + 1
    beside = np.zeros(reach - 1, np.uint64)
    around = _along(np.concatenate([beside, of_window, beside]), reach, np.maximum)
    at = np.flatnonzero(hashes == around)  # the least of one of the windows that it lies in
    return at, hashes[at]


def _firsts(key: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different key, and the number of its rows. ``more`` is a
    second part of the keys, which equal first parts seldom differ in."""
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    if more is not None:
        if (more[order][1:] != more[order][:-1])[~new[1:]].any():
            order = np.lexsort((more, key))
        new[1:] |= more[order][1:] != more[order][:-1]
    start = np.flatnonzero(new)
    return np.minimum.reduceat(order, start), np.diff(start, append=len(order))


def _in_order(rows: list[tuple]) -> list[np.ndarray]:
    """The columns of the documents' rows, (document, arrays); documents ascend."""
    rows = sorted(rows, key=lambda r: r[0])
    return [np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]),
            *(np.concatenate([r[i] for r in rows]) for i in range(1, len(rows[0])))]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents on their way: the text compressed."""
    to = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield _batch("doc blob", batch.column(0), pa.array([to.compress(x.as_py() or b"") for x in batch.column(1)], pa.binary()))


def _words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split()


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], 0

        def combined():
            doc, h, at = _in_order(rows)
            one, n = _firsts(h)
            return _batch("h doc at n", h[one].view(np.int64), doc[one], at[one], n)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, h = anchors_of(word_hashes((text.as_py() or b"").split()), window)
                if len(h):
                    rows.append((doc, h, at.astype(np.int32)))
                    waiting += len(h)
                if waiting > COMBINED_ROWS:
                    yield combined()
                    rows, waiting = [], 0
        if rows:
            yield combined()
    return run


def _suspects(words: list[bytes], single: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose anchor is not at a single place, and word hashes."""
    hashes = word_hashes(words)
    anchors, of_window = window_anchors(hashes, window)
    if not len(of_window):
        return np.zeros(0, np.int64), hashes
    if not len(single):
        return np.arange(len(of_window)), hashes
    change = np.concatenate([[0], np.flatnonzero(of_window[1:] != of_window[:-1]) + 1, [len(of_window)]])
    own, alone = of_window[change[:-1]], np.sort(anchors[single])
    open_ = alone[np.minimum(np.searchsorted(alone, own), len(alone) - 1)] != own
    return np.flatnonzero(np.repeat(open_, np.diff(change))), hashes


def _places(column, i: int) -> np.ndarray:
    value = column[i]
    return value.values.to_numpy() if value.is_valid else np.zeros(0, np.int32)


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], 0

        def combined():
            doc, a, b, at = _in_order(rows)
            one, _ = _firsts(a, b)
            return _batch("a b doc start", a[one].view(np.int64), b[one].view(np.int32), doc[one], at[one])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i, doc in enumerate(docs):
                start, hashes = _suspects(_words(batch.column(1)[i].as_py()), _places(batch.column(2), i), window)
                if len(start):
                    a = _rolled(hashes, window, _BASE)[start]
                    b = (_rolled(hashes, window, _BASE_2)[start] >> np.uint64(32)).astype(np.uint32)
                    rows.append((doc, a, b, start.astype(np.int32)))
                    waiting += len(a)
                if waiting > COMBINED_ROWS:
                    yield combined()
                    rows, waiting = [], 0
        if rows:
            yield combined()
    return run


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First places of the windows of a block, which comes sorted."""
    before = None
    for batch in batches:
        a, b, doc, start = (batch.column(i).to_numpy() for i in range(4))
        if not len(a):
            continue
        new = np.r_[before != (a[0], b[0]), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        before = (a[-1], b[-1])
        yield _batch("doc start", doc[new], start[new])


def factors(repeated: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Greedy factors (first word, words) from the sorted starts of windows that
    have an earlier place. A start within a factor's last window opens the next."""
    if not len(repeated):
        return []
    cut = np.flatnonzero(np.diff(repeated) > 1)
    begin, end = repeated[np.r_[0, cut + 1]], repeated[np.r_[cut, len(repeated) - 1]]
    return list(zip(begin.tolist(), (end - begin + window).tolist(), strict=True))


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, spans = [], [], [], []
            for i in range(batch.num_rows):
                words = _words(batch.column(1)[i].as_py())
                start, _ = _suspects(words, _places(batch.column(2), i), window)
                again = np.zeros(len(words), bool)
                again[start] = True
                again[_places(batch.column(3), i)] = False
                found = factors(np.flatnonzero(again), window)
                keep, kept = 0, []
                for at, n in found:
                    kept += words[keep:at]  # empty where factors overlap
                    keep = max(keep, at + n)
                kept += words[keep:]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([{"start": at, "words": n} for at, n in found])
            yield _batch("doc n_words n_removed kept_sha256 spans", batch.column(0), pa.array(total, pa.int64()),
                         pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))))
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words,
    joined by a space) and the factors as ``spans`` of words."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"),
                        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    ids = None
    if not texts.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc is null").isEmpty():
        ids = numbered(texts.withColumn("hash", F.xxhash64("text")), [F.col("doc").asc_nulls_last(), F.col("hash")], "number")
        texts = ids.select(F.col("number").alias("doc"), "text")

    anchors = texts.mapInArrow(_anchors(window), "h long, doc long, at int, n long")
    single = (anchors.groupBy("h").agg(F.sum("n").alias("n"), F.min("doc").alias("doc"), F.min("at").alias("at"))
              .filter("n = 1").groupBy("doc").agg(F.collect_list("at").alias("single")))
    packed = texts.mapInArrow(_packed, "doc long, blob binary").join(single, "doc", "left").select("doc", "blob", "single")
    windows = packed.mapInArrow(_windows(window), "a long, b int, doc long, start int")
    blocks = windows.repartition("a").sortWithinPartitions("a", "b", "doc", "start")
    firsts = (blocks.mapInArrow(_index_blocks, "doc long, start int").groupBy("doc")
              .agg(F.collect_list("start").alias("firsts")))
    parsed = (packed.join(firsts, "doc", "left").select("doc", "blob", "single", "firsts")
              .mapInArrow(_parse(window), "doc long, n_words long, n_removed long, kept_sha256 string, "
                                          "spans array<struct<start: long, words: long>>"))
    if ids is not None:
        names = ids.select(F.col("number").alias("doc"), F.col("doc").alias("id"))
        parsed = parsed.join(names, "doc").withColumn("doc", F.col("id")).drop("id")
    return parsed.withColumnRenamed("doc", "doc_id")
