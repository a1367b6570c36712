"""Alignment of two tokenizers by galloping intersection.

Both tokenizers cut the same bytes, a space and the text. Where a token of each
ends there is a common cut, and the common cuts part the tokens into groups. They
are the intersection of two sorted lists of ends: each end of the shorter list is
looked for in the longer one from about where it should be, in steps that double
until they pass it, and then by halving the last step. The places found slice both
lists into groups; a token's group on one side and the ranks of the cuts on the
other give the range of tokens that it overlaps.

Every token of a group is linked with every token of the other side in it. A pair
of ids counts the documents that hold it linked, and a link is best if no pair of
the same first id has a higher count. Documents are tokenized once. Their pairs go
to buckets by a hash of both ids, each as one array for many documents; a bucket is
counted by streaming its arrays, with memory for its distinct pairs alone, and
streamed again to look the counts up. An id's highest count is a table with a row
for each id of the first vocabulary, the only thing that is broadcast.

Texts that are null, empty, or not given back byte by byte by either tokenizer have
no tokens: zeros and an empty string. Repeated rows and documents with the same id
count one by one. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import ByteLevel, Memory

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts that are aligned in one go, and bytes of them.
BATCH_TEXTS, BATCH_BYTES = 256, 1 << 20
#: Pairs that a task gathers before it sends them to their buckets.
GATHER_PAIRS = 1 << 18
#: Bytes of text for each bucket of pairs, and the least and greatest number of buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 16, 4096
#: A group with more links than this is counted by its distinct ids.
WIDE_GROUP = 256

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "bucket int, rows array<int>, keys array<long>, links array<long>")


# --- tokens and their bytes ------------------------------------------------------

class Pieces:
    """A sentence-piece tokenizer, which puts a space before the text itself. If no
    piece has a space after another character, or a line break with any, the ids of
    the parts between are looked up; otherwise texts are encoded whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i)
                      else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        own = [x for i, x in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        splits = all(re.fullmatch("▁*[^▁\n]*", x) for x in own)
        self.lead = self.model.encode("\n")  # the space before it and the line break
        same = all(self.model.normalize(x) == "▁" + x.replace(" ", "▁") for x in (" a  b ", "ÄﬁΩ ́e"))
        self.apart = splits and same and len(self.lead) == 2
        self.memory = Memory(lambda part: self._parts([part])[0])

    def _parts(self, parts: list[str]) -> list[bytes]:
        """A part that begins with a space is a text without it; another one is what
        comes after a line break."""
        found = self.model.encode([x[1:] if x[0] == " " else "\n" + x for x in parts], num_threads=1)
        return [array("I", self.lead[:1] if x == " " else self.lead[1:] if x == "\n" else i if x[0] == " " else i[2:]).tobytes()
                for x, i in zip(parts, found, strict=True)]

    PART = re.compile(r" +[^ \n]*|\n|[^ \n]+")

    def encode(self, texts: list[str]) -> list[bytes]:
        self.memory.settle()
        known = self.memory.__getitem__
        parts = [self.PART.findall(" " + x) if x and self.apart and "▁" not in x else None for x in texts]
        self.memory.learn(set().union(*filter(None, parts)), self._parts)
        return [array("I", self.model.encode(x)).tobytes() if own is None else b"".join(map(known, own))
                for x, own in zip(texts, parts, strict=True)]


class Side:
    """A tokenizer with what the alignment needs of its vocabulary."""

    def __init__(self, tokens: ByteLevel | Pieces, after_last: str):
        self.encode, self.bytes = tokens.encode, tokens.bytes
        #: Merges of bytes give back the bytes that they began with.
        self.exact = isinstance(tokens, ByteLevel) and tokens.merger is not None
        self.lengths = np.array([len(x) for x in self.bytes])
        #: Each id with what follows it: inside its group, and as the last of it.
        self.names = np.array([[f"{i}{mark}".encode() for i in range(len(self.bytes))] for mark in (",", after_last)], object)


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """Made once for each worker process, kept while Spark reuses the process."""
    kept = sys.modules.setdefault("_alignment_state", types.ModuleType("_alignment_state"))
    made = vars(kept).setdefault("sides", {})
    if (path_a, path_b) not in made:
        made[path_a, path_b] = Side(ByteLevel(path_a, specials=False), "|"), Side(Pieces(path_b), ";")
    return made[path_a, path_b]


# --- common cuts --------------------------------------------------------------------

def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where in the sorted ``long`` each value of ``short`` stands, or -1. The search
    for a value begins at its ``start``, doubles its step away from there until the
    value lies between, and then halves."""
    n = len(long)
    if not n:
        return np.full(len(short), -1)
    at = np.clip(start, 0, n - 1)
    below = long[at] < short  # go right, or else left
    low, high = np.where(below, at, -1), np.where(below, n, at)  # long[low] < value <= long[high]
    open_, step = np.arange(len(short)), 1
    while len(open_):
        right = below[open_]
        probe = np.where(right, at[open_] + step, at[open_] - step)
        inside = (probe >= 0) & (probe < n)
        open_, probe, right = open_[inside], probe[inside], right[inside]
        less = long[probe] < short[open_]
        low[open_[less]], high[open_[~less]] = probe[less], probe[~less]
        open_ = open_[less == right]  # not passed yet
        step *= 2
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = long[middle] < short[open_]
        low[open_[less]], high[open_[~less]] = middle[less], middle[~less]
        open_ = open_[high[open_] - low[open_] > 1]
    return np.where((high < n) & (long[np.minimum(high, n - 1)] == short), high, -1)


def common_cuts(a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the ends that both have. The ends ascend through
    several texts; ``a_of`` and ``b_of`` are the first places of each text, and the
    length. For each text the shorter list drives."""
    n_a, n_b = np.diff(a_of), np.diff(b_of)
    out_a, out_b = [], []
    for short, long, s_of, l_of, n_s, n_l, own, first in (
            (a, b, a_of, b_of, n_a, n_b, n_a <= n_b, True), (b, a, b_of, a_of, n_b, n_a, n_a > n_b, False)):
        text = np.repeat(np.flatnonzero(own), n_s[own])
        if not len(text):
            continue
        rank = np.arange(len(text)) - np.repeat(np.cumsum(n_s[own]) - n_s[own], n_s[own])
        place = s_of[text] + rank
        found = gallop(short[place], long, l_of[text] + rank * n_l[text] // np.maximum(n_s[text], 1))
        hit = found >= 0
        out_a.append(place[hit] if first else found[hit])
        out_b.append(found[hit] if first else place[hit])
    cut_a, cut_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    order = np.argsort(cut_a, kind="stable")
    return cut_a[order], cut_b[order]


def overlaps(cuts: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of one side the first place and the end of the tokens of the
    other side that its group has, from the places of the common cuts on both."""
    n, m = np.diff(cuts, prepend=-1), np.diff(others, prepend=-1)
    return np.repeat(others + 1 - m, n), np.repeat(others + 1, n)


def order_of(*keys: np.ndarray) -> np.ndarray:
    """An order by ``keys``, the first one weighing most. They are put into one number
    where they have room in it, which sorts in a single pass."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    one = keys[0].astype(np.int64)
    for k, n in zip(keys[1:], bits[1:], strict=True):
        one = (one << n) | k
    return np.argsort(one)


def linked(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray,
           group_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links) of the different pairs linked in each text. A pair is the
    first id times 2^32 plus the second."""
    n, m = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    wide = n * m > WIDE_GROUP
    first, end = overlaps(cut_a, cut_b)
    group = np.repeat(np.arange(len(n)), n)
    keep = np.flatnonzero(~wide[group])
    width = (end - first)[keep]
    token = np.repeat(keep, width)
    other = np.repeat(first[keep], width) + np.arange(len(token)) - np.repeat(np.cumsum(width) - width, width)
    texts, pairs, links = [group_text[group[token]]], [(a[token].astype(np.int64) << 32) + b[other]], [np.ones(len(token), np.int64)]
    for g in np.flatnonzero(wide):
        ids, count = np.unique(a[cut_a[g] + 1 - n[g]:cut_a[g] + 1], return_counts=True)
        with_ids, with_count = np.unique(b[cut_b[g] + 1 - m[g]:cut_b[g] + 1], return_counts=True)
        pairs.append(((ids.astype(np.int64) << 32)[:, None] + with_ids).ravel())
        links.append((count[:, None] * with_count).ravel())
        texts.append(np.full(len(pairs[-1]), group_text[g]))
    text, pair, n_links = map(np.concatenate, (texts, pairs, links))
    if not len(text):
        return text, pair, n_links
    order = order_of(text, pair >> 32, pair & 0xFFFFFFFF)
    text, pair = text[order], pair[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])
    return text[new], pair[new], np.add.reduceat(n_links[order], new)


class Alignment:
    """The groups of several texts."""

    def __init__(self, texts: list[str], a: Side, b: Side):
        self.a, self.b = a, b
        whole = [(" " + x).encode() if x else b"" for x in texts]
        ids = [[np.frombuffer(x, np.uint32) for x in c.encode(own)] for c, own in ((a, [" " + x for x in texts]), (b, texts))]
        ok = [bool(w) and all(c.exact or b"".join(map(c.bytes.__getitem__, x[k].tolist())) == w for c, x in zip((a, b), ids, strict=True))
              for k, w in enumerate(whole)]
        none = np.zeros(0, np.uint32)
        self.ids, self.of, ends = [], [], []
        for c, x in zip((a, b), ids, strict=True):
            x = [i if good else none for i, good in zip(x, ok, strict=True)]
            self.ids.append(np.concatenate([none, *x]).astype(np.int64))
            self.of.append(np.cumsum([0, *map(len, x)]))
            ends.append(np.cumsum(c.lengths[self.ids[-1]]))
        self.cuts = common_cuts(*ends, *self.of)
        self.group_text = np.searchsorted(self.of[0], self.cuts[0], "right") - 1
        self.groups = np.bincount(self.group_text, minlength=len(texts))
        self.n = [np.diff(x) for x in self.of]
        sizes = [np.diff(x, prepend=-1) for x in self.cuts]
        self.links = np.bincount(self.group_text, sizes[0] * sizes[1], len(texts)).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return linked(*self.ids, *self.cuts, self.group_text)

    def digests(self) -> list[str]:
        """Of each text's groups, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        side = [np.zeros(len(x), bool) for x in self.ids]
        for last, cut in zip(side, self.cuts, strict=True):
            last[cut] = True
        group = [np.cumsum(x) - x for x in side]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        words = np.concatenate([c.names[last.astype(int), ids] for c, last, ids in zip((self.a, self.b), side, self.ids, strict=True)])
        words, bounds = words[order].tolist(), (self.of[0] + self.of[1]).tolist()
        return [hashlib.sha256(b"".join(words[s:e])[:-1]).hexdigest() if e > s else ""
                for s, e in zip(bounds, bounds[1:], strict=False)]


# --- the operator --------------------------------------------------------------------

def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (pairs.astype(np.uint64) ^ (pairs.astype(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, buckets: int, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """A row per document with its counts and digest, and rows with a ``bucket`` that
    hold pairs of many documents: the rows' numbers, the pairs and their links."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k)
                                           for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(tokenizer_a, tokenizer_b)
        task, at, gathered, waiting, base = TaskContext.get().partitionId() << 33, 0, [], 0, 0

        def sent():
            text, pair, links = (np.concatenate(x) for x in zip(*gathered, strict=True))
            bucket = bucket_of(pair, buckets)
            order = order_of(bucket, pair >> 32, pair & 0xFFFFFFFF, text)
            text, pair, links, bucket = text[order], pair[order], links[order], bucket[order]
            own = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = [*own[1:].tolist(), len(bucket)]
            cut = lambda x: [x[s:e] for s, e in zip(own.tolist(), ends, strict=True)]
            return batch_of(len(own), row=np.full(len(own), task + base), bucket=bucket[own], rows=cut(text.astype(np.int32)),
                            keys=cut(pair), links=cut(links))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in texts])
            start = 0
            while start < len(ids):
                before = size[start - 1] if start else 0
                end = max(start + 1, min(start + BATCH_TEXTS, int(np.searchsorted(size, before + BATCH_BYTES))))
                found = Alignment([x.as_py() or "" for x in texts[start:end]], a, b)
                n = end - start
                yield batch_of(n, row=task + at + np.arange(n), doc_id=ids[start:end], n_a=found.n[0], n_b=found.n[1],
                               n_groups=found.groups, n_links=found.links, groups_sha256=found.digests())
                text, pair, links = found.pairs()
                if len(text):
                    gathered.append((text + at - base, pair, links))
                    waiting += len(text)
                at, start = at + n, end
                if waiting > GATHER_PAIRS:
                    yield sent()
                    gathered, waiting, base = [], 0, at
        if gathered:
            yield sent()

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, ALIGNED)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(count[order], new) if len(key) else count


def _arrays(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


COUNTS, LOOKED_UP = "bucket int, keys array<long>, counts array<long>", "row long, n_best long, count_sum long"
#: Pairs of a bucket's table in one row.
TABLE_PAIRS = 1 << 18


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each pair of a bucket, from its rows one after the other."""
    def table(bucket, keys, counts):
        key, count = _merged(keys, counts)
        for s in range(0, len(key), TABLE_PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([key[s:s + TABLE_PAIRS]], pa.list_(pa.int64())),
                                              pa.array([count[s:s + TABLE_PAIRS]], pa.list_(pa.int64()))], names=["bucket", "keys", "counts"])

    current, keys, counts, waiting = None, [], [], 0
    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != current:
                if keys:
                    yield from table(current, keys, counts)
                current, keys, counts, waiting = bucket, [], [], 0
            own, n = np.unique(_arrays(batch, "keys", i), return_counts=True)
            keys.append(own)
            counts.append(n)
            waiting += len(own)
            if waiting > max(2 * len(keys[0]), GATHER_PAIRS):
                key, count = _merged(keys, counts)
                keys, counts, waiting = [key], [count], len(key)
    if keys:
        yield from table(current, keys, counts)


def _look_up(highest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, most = highest.value
        current, keys, counts, table = None, [], [], None
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != current:
                    current, keys, counts, table = bucket, [], [], None
                if batch.column("counts")[i].is_valid:  # the bucket's table comes before its rows
                    keys.append(_arrays(batch, "keys", i))
                    counts.append(_arrays(batch, "counts", i))
                    continue
                if table is None:
                    key, count = np.concatenate(keys), np.concatenate(counts)
                    best = count == most[np.searchsorted(ids, key >> 32)]
                    table, keys, counts = (key, count, best), [], []
                key, count, best = table
                row, links = _arrays(batch, "rows", i), _arrays(batch, "links", i)
                at = np.searchsorted(key, _arrays(batch, "keys", i))
                sums, bests = (np.bincount(row, links * x[at]).astype(np.int64) for x in (count, best))
                own = np.unique(row)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64) + batch.column("row")[i].as_py()), pa.array(bests[own]), pa.array(sums[own])],
                                                 names=["row", "n_best", "count_sum"])
    return run


def alignment(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256. The tokenizers are files that every node has."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))).alias("n")).first()["n"] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    aligned = written(align(docs, tokenizer_a, tokenizer_b, buckets, id_col, text_col), "aligned")
    pairs = aligned.filter("bucket is not null").select("bucket", "row", "rows", "keys", "links")
    counts = written(pairs.select("bucket", "keys").repartition(buckets, "bucket").sortWithinPartitions("bucket")
                     .mapInArrow(_count, COUNTS), "pair-counts")
    top = counts.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy(
        F.shiftright("x.keys", 32).alias("a")).agg(F.max("x.counts").alias("most")).orderBy("a").toPandas()
    highest = spark.sparkContext.broadcast((top["a"].to_numpy(np.int64), top["most"].to_numpy(np.int64)))
    none = lambda kind: F.lit(None).cast(kind)
    both = (counts.select("bucket", none("long").alias("row"), none("array<int>").alias("rows"), "keys",
                          none("array<long>").alias("links"), "counts")
            .unionByName(pairs.withColumn("counts", none("array<long>"))))
    found = (both.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("counts").isNull(), F.col("keys")[0])
             .mapInArrow(_look_up(highest), LOOKED_UP))
    sums = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = aligned.filter("bucket is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
